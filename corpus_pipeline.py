"""A training corpus in five stages: each writes its documents as Parquet, and the next reads them.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows
and columns beside COLUMNS, which it leaves out; of an empty table it makes an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import decontaminate, line_dedup, near_dedup, queries, toxicity
from weftspark.llm.common import new_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the labels of the training folds teach the score.

    Null and empty texts score as texts without words; without labels of both kinds all score alike,
    0 where nothing is labelled, and stay.
    """
    score = toxicity.score(queries.toxic_model(spark, docs, sf_dir))
    return docs.select(*COLUMNS, score("text").alias("_score")).where("_score < 0.5").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; n_chars counts what is left.

    Null texts become empty. Rows of one id are one document to the count, null ids too; each stays.
    """
    kept = line_dedup.dedup_lines(docs, keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the `_key` of each row: its id, null after all others, and a 64-bit digest of its text."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    return docs.select(*COLUMNS, key.alias("_key"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each group of near copies; of rows equal in id and text one.

    Texts without words link with nothing and stay. Ties between equal keys fall to the smallest other columns.
    """
    rows = keyed(docs)
    kept = near_dedup.near_duplicates(rows, "_key").where("kept").select(F.col("_key").alias("_kept")).distinct()
    found = rows.join(kept, F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("_rest")
    return found.groupBy("_key").agg(F.first("text").alias("text"), rest).select(
        F.col("_key.id").alias("doc_id"), "text", "_rest.lang", "_rest.source", "_rest.n_chars"
    )


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one id stand for themselves, null ids too. Null texts hold none."""
    rows = keyed(docs)
    held = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), "_key", short=True).select(F.col("_key").alias("_held")).distinct()
    return rows.join(held, F.col("_key").eqNullSafe(F.col("_held")), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; every row has its row, null and empty texts with 0 words, null sources as one source."""
    return queries.mixed(spark, docs, sf_dir).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: SQL can't express the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """The stages applied to `documents`, by way of Parquet in the folder that all executors share; each stage's files go when the next one's are written.

    at: the folder of this run. A run that died goes on from its last whole stage if it is named again.
    """
    at = at or new_folder(spark, "pipeline")
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    names = [name for name, _ in STAGES]
    done = max((k + 1 for k, name in enumerate(names) if files.exists(path(f"{name}/_SUCCESS"))), default=0)
    docs = spark.read.parquet(f"{at}/{names[done - 1]}") if done else table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[done:], done):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if k:
            files.delete(path(names[k - 1]), True)
    return docs
