import numpy as np

from weftspark.operators import blocks, similar, vectors


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_where_they_are_settled(spark):
    rows = spark.range(200).selectExpr("id", "array(id, null) AS v")
    few, many = blocks.packed(rows, "id", 60), blocks.packed(rows, "id", 20)
    held = [i for r in many.collect() for i in blocks.unpacked(r.block).id]
    assert sorted(held) == list(range(200)) and many.count() >= 10 and max(r.n for r in many.collect()) <= 25
    met = blocks.meeting(few, many)
    assert met.count() == few.count() * many.count() and met.rdd.getNumPartitions() == few.rdd.getNumPartitions() * many.rdd.getNumPartitions()
    assert "Exchange" not in _plan(met)


def test_no_vector_is_shuffled_to_the_blocks_it_meets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (300, 8)).astype(float)
    v[50:80] = v[50]
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, v array<double>")
    asked = chunks.selectExpr("concat('q', chunk_id) AS qid", "v AS q").where("qid like '%5'")
    whole = sorted(map(tuple, vectors.knn(asked, chunks, 4, digits=9).collect()))
    near = sorted(map(tuple, similar.within(asked, chunks, 0.8).collect()))
    for name in ("ASKED", "HELD"):
        monkeypatch.setattr(vectors, name, 20)
        monkeypatch.setattr(similar, name, 10)
    cut, pairs = vectors.knn(asked, chunks, 4, digits=9), similar.within(asked, chunks, 0.8)
    assert sorted(map(tuple, cut.collect())) == whole and sorted(map(tuple, pairs.collect())) == near
    assert "Exchange" not in _plan(pairs) and "CoGroup" not in _plan(cut)


def test_blocks_of_a_task_leave_only_the_best(spark, monkeypatch):
    """However many blocks a task meets, it gives k rows a question."""
    monkeypatch.setattr(vectors, "HELD", 20)
    monkeypatch.setattr(blocks, "TASKS", 1)
    given = []
    monkeypatch.setattr(vectors, "top", lambda found, *rest: given.append(found.count()) or vectors_top(found, *rest))
    chunks = spark.range(160).selectExpr("id AS chunk_id", "array(1D, id % 7D) AS v")
    asked = spark.range(3).selectExpr("id AS qid", "array(1D, 2D) AS q")
    found = vectors.knn(asked, chunks, 2)
    assert given == [6] and sorted((r.qid, r["rank"], r.chunk_id) for r in found.collect()) == [(q, n, c) for q in range(3) for n, c in ((1, 2), (2, 9))]


vectors_top = vectors.top
