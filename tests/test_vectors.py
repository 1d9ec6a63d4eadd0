"""Searches against numpy: ties, filters, groups; cells with and without a filter; similarity joins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftspark.operators import cells, similar, vectors

CHUNKS = "chunk_id long, v array<double>, label int, r int, parent_id long"


def _plain(q, rows, k, wanted=None, clearance=None, by=False):
    out = []
    for i, v, label, r, parent in rows:
        if v is None or (wanted is not None and label not in wanted) or (clearance is not None and (r is None or r > clearance)):
            continue
        n = np.linalg.norm(q) * np.linalg.norm(v)
        out.append((float(np.dot(q, v) / n) if n else 0.0, parent if by else i, i))
    out = [(round(s, 9), a, b) for s, a, b in out]
    if by:
        best = {}
        for s, p, i in sorted(out, key=lambda x: (-x[0], x[2])):
            best.setdefault(p, (s, p, i))
        out = list(best.values())
    return [(a, s) for s, a, _ in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.fixture(scope="module")
def clustered():
    """600 chunks around 12 directions, ties and zeros among them."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + 0.15 * rng.normal(size=16)).round(3).tolist(), int(i // 12 % 10), int(i % 3 + 1), i // 5) for i in range(600)]
    rows[17] = (17, rows[5][1], 5, 1, 3)
    rows[18] = (18, [0.0] * 16, 5, 1, 3)
    rows[19] = (19, None, 5, 1, 3)
    rows[20] = (20, rows[20][1], None, None, 4)
    return rows


def test_search_of_blocks_against_numpy(spark, clustered, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 100)
    monkeypatch.setattr(vectors, "ROWS", 7)
    chunks = spark.createDataFrame(clustered, CHUNKS)
    asked = [(i, clustered[i][1], [1, 5] if i % 3 else None, i % 4 or None) for i in range(0, 600, 25)] + [(1000, [0.0] * 16, None, None), (1001, clustered[3][1], [], 3)]
    questions = spark.createDataFrame(asked, "qid long, q array<double>, wanted array<int>, clearance int")
    for by in (None, "parent_id"):
        found = {}
        for r in vectors.knn(questions, chunks, 7, by=by, digits=9).collect():
            found.setdefault(r.qid, []).append((r["rank"], r[by or "chunk_id"], r.score))
        for qid, q, wanted, clearance in asked:
            assert [(a, pytest.approx(s, abs=1e-8)) for _, a, s in sorted(found.get(qid, []))] == _plain(q, clustered, 7, wanted, clearance, bool(by)), (qid, by)
    assert vectors.knn(questions, chunks, 0).count() == 0 and vectors.knn(questions, chunks.limit(0), 3).count() == 0


def test_cells_find_most_and_see_little_of_clustered_vectors(spark, clustered):
    chunks = spark.createDataFrame(clustered, CHUNKS)
    index = cells.Cells(chunks, cells=12, held=20)
    assert index.sizes.agg(F.sum("held")).first()[0] == 598 and index.sizes.agg(F.max("parts")).first()[0] > 1
    asked = [(i, clustered[i][1], None, None) for i in range(0, 600, 25)]
    narrow = [(i, clustered[i][1], [int(i // 12 % 10)], 2) for i in range(0, 600, 25)]
    for rows in (asked, narrow):
        questions = spark.createDataFrame(rows, "qid long, q array<double>, wanted array<int>, clearance int")
        found = {}
        for r in cells.search(index, questions, 10, probes=1).collect():
            found.setdefault(r.qid, []).append(r)
        hits = seen = wanted_hits = 0
        for qid, q, wanted, clearance in rows:
            best = [a for a, _ in _plain(q, clustered, 10, wanted, clearance)]
            wanted_hits += len(best)
            hits += len({r.chunk_id for r in found[qid]} & set(best))
            seen += found[qid][0].seen
            assert all((wanted is None or clustered[r.chunk_id][2] in wanted) and (clearance is None or clustered[r.chunk_id][3] <= clearance) for r in found[qid])
        assert hits >= 0.9 * wanted_hits
        if rows is asked:
            assert seen <= 598 * len(rows) / 3


def test_cells_asked_for_exact_answers(spark, clustered):
    chunks = spark.createDataFrame(clustered, CHUNKS)
    index = cells.Cells(chunks, cells=12)
    asked = [(i, clustered[i][1], [1, 5] if i % 2 else None, 3 if i % 3 else None) for i in range(0, 600, 25)]
    questions = spark.createDataFrame(asked, "qid long, q array<double>, wanted array<int>, clearance int")
    rows = cells.search(index, questions, 10, probes=1, exact=True).collect()
    for qid, q, wanted, clearance in asked:
        own = [r.chunk_id for r in sorted((r for r in rows if r.qid == qid), key=lambda r: r["rank"])]
        assert own == [a for a, _ in _plain(q, clustered, 10, wanted, clearance)]
    assert sum({r.qid: r.seen for r in rows}.values()) < 598 * len(asked) / 2
    assert cells.search(index, questions, 0).count() == 0
    assert cells.search(cells.Cells(chunks.limit(0)), questions, 5).count() == 0
    few = cells.search(index, questions.where("qid = 0").withColumn("wanted", F.array(F.lit(77))), 5)
    assert few.count() == 0


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95, 1.0])
def test_pairs_above_a_bound_against_all_pairs(spark, least):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = np.zeros(40)
        at = rng.choice(40, rng.integers(1, 25), replace=False)
        v[at] = rng.integers(-4, 5, len(at))
        rows.append((i, v.tolist()))
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, [0.0] * 40), (401, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    questions = chunks.where("chunk_id % 7 = 0 or chunk_id > 399").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"))
    found = {(r.qid, r.chunk_id): r.score for r in similar.within(questions, chunks, least).collect()}
    expected = {}
    for i, q in rows:
        if (i % 7 == 0 or i > 399) and q is not None and any(q):
            for j, v in rows:
                if v is not None and any(v):
                    s = round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9)
                    if s >= least:
                        expected[i, j] = s
    assert found.keys() == expected.keys() and all(abs(found[p] - s) < 1e-8 for p, s in expected.items())
    assert similar.within(questions.limit(0), chunks, least).count() == 0
    with pytest.raises(ValueError):
        similar.candidates(questions, chunks, 0.0)


def test_a_bound_spares_most_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.bincount(rng.integers(0, 256, 30), minlength=256)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    questions = chunks.where("chunk_id < 40").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"))
    assert similar.candidates(questions, chunks, 0.9).count() < similar.candidates(questions, chunks, 0.3).count() < 40 * 400


def test_search_in_blocks_makes_each_vector_once_and_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (500, 16)).astype(float)
    v[40:60], v[3] = v[40], 0
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def vector(ids: pd.Series) -> pd.Series:
        made.add(len(ids))
        return pd.Series([None if i == 7 else v[i].tolist() for i in ids])

    monkeypatch.setattr(vectors, "HELD", 200)
    monkeypatch.setattr(vectors, "COLUMNS", 64)
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), vector("id").alias("v"))
    questions = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 500, 9)], "qid long, q array<double>")
    found = {}
    for r in vectors.knn(questions, chunks, 12, digits=9).collect():
        found.setdefault(r.qid, []).append((r["rank"], r.chunk_id))
    length = np.linalg.norm(v, axis=1)
    for i in range(0, 500, 9):
        score = np.round(np.divide(v @ v[i], length * length[i], out=np.zeros(500), where=length * length[i] > 0), 9)
        score[7] = -2
        assert [c for _, c in sorted(found[i])] == np.lexsort((np.arange(500), -score))[:12].tolist()
    assert made.value == 500


def test_pairs_above_a_bound_are_not_moved_and_grouped_in_their_block(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, (120, 12)).astype(float)
    chunks = spark.createDataFrame([(i, f"d{i % 40}", v[i].tolist()) for i in range(120)], "chunk_id long, s string, v array<double>")
    questions = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 120, 11)], "qid long, q array<double>")
    found = {(r.qid, r.s): r.score for r in similar.within(questions, chunks, 0.6, extra=["s"], by="s").collect()}
    length, expected = np.linalg.norm(v, axis=1), {}
    for i in range(0, 120, 11):
        for j in range(120):
            score = round(float(v[i] @ v[j] / length[i] / length[j]), 9)
            if score >= 0.6:
                expected[i, f"d{j % 40}"] = max(score, expected.get((i, f"d{j % 40}"), 0))
    assert found.keys() == expected.keys() and all(abs(found[p] - s) < 1e-8 for p, s in expected.items())


def test_a_pair_of_shared_buckets_counts_once(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(vectors, "HELD", 100)
    v = np.random.default_rng(7).normal(size=(240, 8))
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, v array<double>")
    questions = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"))
    unit = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "id long, v array<double>").select("id", array_to_vector("v").alias("u"))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=0.5, numHashTables=3, seed=7).fit(unit)
    h = {r.id: [x[0] for x in r.h] for r in model.transform(unit).collect()}
    found = {}
    for r in vectors.approximate(questions, chunks, 5, tables=3).collect():
        found.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.seen))
    near = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(0, 240, 20):
        met = [j for j in range(240) if any(a == b for a, b in zip(h[i], h[j], strict=True))]
        best = sorted(met, key=lambda j: (-float(near[i] @ near[j]), j))[:5]
        assert sorted(found[i]) == [(n + 1, j, len(met)) for n, j in enumerate(best)]
