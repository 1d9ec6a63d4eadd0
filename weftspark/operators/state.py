"""Cutting lineage, and what a run leaves behind: snapshots, the state of documents, and the commit up to which they are in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where all executors read and write; only a local master may lack spark.checkpoint.dir."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared is None:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="weftspark-")
        context.setCheckpointDir(shared)
    return shared


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows that go to every task at most.
FEW = 1 << 18


def brought(df: DataFrame, most: int) -> DataFrame:
    """df, of `most` rows at most: if these are no more than FEW, a join brings them to the other side, which then isn't shuffled."""
    return F.broadcast(df) if most <= FEW else df


def few(df: DataFrame) -> DataFrame:
    """`settle`, and where df has few rows, `brought`."""
    df = settle(df)
    return brought(df, df.count())


def publish(df: DataFrame, root: str, version: int) -> None:
    """Writes a snapshot and then, last, the pointer to it; a crash in between leaves the old pointer."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/pointer")


def version_of(spark: SparkSession, root: str) -> int | None:
    """The version that the pointer names; null where nothing was ever published, which is no baseline."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("version long").json(f"{root}/pointer").agg(F.max("version")).first()[0]


def published(spark: SparkSession, root: str) -> DataFrame:
    version = version_of(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published in {root}")
    return spark.read.parquet(f"{root}/v={version}")


def cache_key(fp: Column, hash_: Column, what: str) -> Column:
    """silver/<fp>/<hash>/<what>; only hexadecimal parts make a key."""
    good = fp.rlike("^[0-9a-f]+$") & hash_.rlike("^[0-9a-f]+$")
    return F.when(good, F.concat(F.lit("silver/"), fp, F.lit("/"), hash_, F.lit(f"/{what}")))


def upgraded(entries: DataFrame) -> DataFrame:
    """Entries (doc_id, entry) of a state of either version, entry a JSON object or a bare hash, as (doc_id, content_hash, stage, silver_chunks, silver_candidates).

    A bare hash is an entry of the first version: its document stands at the first stage and has no artifacts.
    """
    new = F.ltrim("entry").startswith("{")
    field = lambda name: F.when(new, F.get_json_object("entry", f"$.{name}"))
    return entries.select(
        "doc_id",
        F.when(new, F.coalesce(field("content_hash"), F.lit(""))).otherwise(F.col("entry")).alias("content_hash"),
        F.coalesce(field("stage"), F.lit("bronze")).alias("stage"),
        field("silver_chunks").alias("silver_chunks"),
        field("silver_candidates").alias("silver_candidates"),
    )


def manifest(state: DataFrame) -> DataFrame:
    return state.select("doc_id", F.col("content_hash").alias("hash"))


def manifest_json(current: DataFrame) -> DataFrame:
    """Lines of JSON (doc_id, line) of a manifest (doc_id, hash), for export in the order of their ids."""
    return current.select("doc_id", F.to_json(F.struct("doc_id", "hash")).alias("line"))


def next_state(current: DataFrame, before: DataFrame, embedder_fp: str, extraction_fp: str | None = None) -> DataFrame:
    """The state after a run over a manifest (doc_id, hash): every document at the last stage, its chunks' key by the embedder.

    The key of its candidates is made anew where extraction ran, else carried over from a
    state `before` with the same content, else null.
    """
    old = before.select("doc_id", F.col("content_hash").alias("_hash"), F.col("silver_candidates").alias("_key"))
    kept = F.when(F.col("_hash") == F.col("hash"), F.col("_key"))
    candidates = kept if extraction_fp is None else cache_key(F.lit(extraction_fp), F.col("hash"), "candidates")
    return current.join(old, "doc_id", "left").select(
        "doc_id", F.col("hash").alias("content_hash"), F.lit("gold").alias("stage"), cache_key(F.lit(embedder_fp), F.col("hash"), "chunks").alias("silver_chunks"), candidates.alias("silver_candidates")
    )


def watermark(written: str | None) -> str | None:
    """A commit that was written as the mark of the last run; anything but 7 to 64 hexadecimal digits is none, so that all is scanned."""
    import re

    bare = (written or "").strip()
    return bare if re.fullmatch(r"[0-9a-f]{7,64}", bare) else None


def name_status(lines: DataFrame) -> DataFrame:
    """(action, path, old_path) of lines (line): added, modified and deleted paths; a rename deletes and adds. Other codes and short lines go."""
    bare = F.btrim(F.col("line"), F.lit(" \t\n\x0b\f\r"))
    part = F.split(bare, "\t", -1)
    at = lambda i: F.get(part, i)
    one = lambda action, path, old: F.struct(F.lit(action).alias("action"), path.alias("path"), old.alias("old_path"))
    none = F.lit(None).cast("string")
    told = (
        F.when(at(0).rlike("^R[0-9]+$") & (F.size(part) >= 3), F.array(one("deleted", at(1), none), one("added", at(2), at(1))))
        .when((at(0) == "A") & (F.size(part) >= 2), F.array(one("added", at(1), none)))
        .when((at(0) == "M") & (F.size(part) >= 2), F.array(one("modified", at(1), none)))
        .when((at(0) == "D") & (F.size(part) >= 2), F.array(one("deleted", at(1), none)))
    )
    return lines.select(F.inline(told))
