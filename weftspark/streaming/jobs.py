"""Structured Streaming jobs over the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftspark.operators import documents
from weftspark.operators.store import Store

#: The table of a store that names the batches that it holds.
BATCHES = {"batches": ["stream", "batch"]}


def metrics(calls: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Calls, errors and mean value of each tool (ts, event_type, value) in tumbling windows; calls that come later than `late` don't count."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 0).alias("errors"), F.avg("value").alias("mean_value"))
        .select("w.start", "event_type", "calls", "errors", "mean_value")
    )


def incremental(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `run` on what is new since the last run, once, and ends; the checkpoint is the manifest."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(run).start()


def committed(store: Store, step: Callable[[DataFrame], tuple[dict[str, DataFrame], dict[str, DataFrame]]], stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: what `step` makes of a batch - (rows, keys that go) by table - enters the store in one commit that also names the batch.

    A batch that comes again, since the run died before its checkpoint but after its commit, is known by its
    number and changes nothing; one whose commit was not reached changes everything once. The store has BATCHES among its tables.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if store.count("batches") > 0 and not store.read("batches").where((F.col("stream") == stream) & (F.col("batch") == number)).isEmpty():
            return
        rows, gone = step(batch)
        mark = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"), F.current_timestamp().alias("at"))
        store.commit({**rows, "batches": mark}, gone)

    return run


#: The tables of a store that a stream of governed files fills; files that failed wait in `pending`.
GOVERNED = {**documents.ARTIFACTS, "pending": ["path"], **BATCHES}


def governed(store: Store, repo: str) -> Callable[[DataFrame], tuple[dict[str, DataFrame], dict[str, DataFrame]]]:
    """A step over batches of files (path, sha, text): each batch is processed together with the files that failed before.

    Of a path that a batch has, only the newest text there counts, in the batch before the pending one. What a file's document had is
    replaced. Files that fail again stay pending, so that the stream goes on past them and none is forgotten.
    """

    def step(batch: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        spark = batch.sparkSession
        files = batch.groupBy("path").agg(F.max(F.struct("sha", "text")).alias("f")).select("path", "f.sha", "f.text")
        if store.count("pending") > 0:
            files = files.unionByName(store.read("pending").select("path", "sha", "text").join(files, "path", "left_anti"))
        files = documents.settle(files)
        outcomes, quads, chunks = documents.process(files, spark, repo)
        failed = files.join(outcomes.where("outcome = 'error'").select("path"), "path", "left_semi")
        commits = outcomes.select("s", "sha")
        rows = {"reports": outcomes, "triples": quads.join(commits, "s"), "chunks": chunks.join(commits, "s"), "pending": failed}
        touched = outcomes.select("s")
        return rows, {"triples": touched, "chunks": touched, "pending": files.select("path").join(failed.select("path"), "path", "left_anti")}

    return step
