"""Streams: batches that come again, files that fail and are tried anew, late rows."""

import json

import pytest
from pyspark.sql import functions as F

from weftspark.operators import documents
from weftspark.operators.store import Store
from weftspark.sources import governed as src
from weftspark.streaming import jobs

FILE = "path string, sha string, text string"


def _put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def _text(n):
    return f"# Heading {n}\n\n" + f"This is document number {n} and it says a great deal about many things. " * 6


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"rows": ["k"], **jobs.BATCHES})
    died = []

    def step(batch):
        return {"rows": batch.groupBy("k").agg(F.count("*").alias("n"))}, {}

    run = jobs.committed(store, step)

    def dying(batch, number):
        run(batch, number)
        if not died:
            died.append(number)
            raise RuntimeError("died after the commit")

    _put(tmp_path / "in", "a.json", [{"k": 1}, {"k": 1}, {"k": 2}])
    stream = lambda: spark.readStream.schema("k int").json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="died after the commit"):
        jobs.incremental(stream(), dying, str(tmp_path / "c")).awaitTermination()
    version = store.pointer()[0]
    jobs.incremental(stream(), dying, str(tmp_path / "c")).awaitTermination()
    assert store.pointer()[0] == version and sorted(map(tuple, store.read("rows").collect())) == [(1, 2), (2, 1)]
    _put(tmp_path / "in", "b.json", [{"k": 2}])
    jobs.incremental(stream(), dying, str(tmp_path / "c")).awaitTermination()
    assert store.pointer()[0] == version + 1 and sorted(map(tuple, store.read("rows").collect())) == [(1, 2), (2, 1)]
    assert store.read("batches").count() == 2


def test_failed_files_wait_and_are_tried_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), jobs.GOVERNED)
    run = jobs.committed(store, jobs.governed(store, src.REPO))
    stream = lambda: spark.readStream.schema(FILE).json(str(tmp_path / "in"))
    go = lambda: jobs.incremental(stream(), run, str(tmp_path / "c")).awaitTermination()
    _put(tmp_path / "in", "a.json", [{"path": "sop/a.md", "sha": "c1", "text": _text(1)}, {"path": "sop/b.xyz", "sha": "c1", "text": _text(2)}])
    go()
    state = lambda: {r.path: r.outcome for r in store.read("reports").collect()}
    assert state() == {"sop/a.md": "loaded", "sop/b.xyz": "error"}
    assert [r.path for r in store.read("pending").collect()] == ["sop/b.xyz"]
    before = state()
    # the next batch takes it in again, and a new text of the first document replaces its rows
    _put(tmp_path / "in", "b.json", [{"path": "sop/a.md", "sha": "c2", "text": _text(3)}])
    go()
    assert state().keys() == before.keys() and [r.path for r in store.read("pending").collect()] == ["sop/b.xyz"]
    assert {r.sha for r in store.read("reports").where("path = 'sop/a.md'").collect()} == {"c2"}
    assert {r.sha for r in store.read("chunks").collect()} <= {"c2"} and {r.sha for r in store.read("triples").collect()} <= {"c2"}
    assert store.read("batches").count() == 2


def test_late_calls_do_not_count(spark, tmp_path):
    call = lambda ts, value=1.0: {"ts": ts, "event_type": "t", "value": value}
    stream = lambda: spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "in"))

    def go():
        query = jobs.metrics(stream()).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    _put(tmp_path / "in", "1.json", [call("2024-01-01T00:10:00Z"), call("2024-01-01T00:20:00Z", -1.0), call("2024-01-01T02:00:00Z")])
    go()
    _put(tmp_path / "in", "2.json", [call("2024-01-01T00:30:00Z"), call("2024-01-01T02:30:00Z"), call("2024-01-01T05:00:00Z")])
    go()
    found = {r.start.isoformat(): (r.calls, r.errors, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(found.values()) == [(2, 0, 1.0), (2, 1, 0.0)]


def test_documents_are_embedded_to_the_end(spark):
    files = spark.createDataFrame([("sop/a.md", "c1", _text(1)), ("sop/b.xyz", "c1", _text(2))], FILE)
    outcomes, quads, chunks = documents.process_embedded(files, spark, src.REPO)
    loaded = {r.s for r in outcomes.where("outcome = 'loaded'").collect()}
    rows = chunks.collect()
    assert {r.s for r in rows} == loaded and all(len(r.v) == 256 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in rows)
    told = {r.s for r in quads.where("p = 'embeddingModel' and o = 'hash-256'").collect()}
    assert told == {f"urn:chunk:{r.s}#{r.ordinal}" for r in rows}
