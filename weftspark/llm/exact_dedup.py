"""Exact duplicates by a persistent index of text digests.

The index is a table bucketed and sorted by digest: one row for each text that was ever
added. A batch of new rows is reduced to its distinct digests, which meet the index
in a sort-merge anti-join; those that it lacks are appended with the row that stands for
them. What stands once stays: the rows of later batches with that text are dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.common import settle

#: Buckets of a new index. A bucket is read by one task: choose about one for each 256 MB of digests (40 bytes a text) that are to come.
BUCKETS = 32
#: A digest with more than this share of all rows is met by broadcast: there are fewer than 1 / SHARE of them.
SHARE = 1e-3


class DigestIndex:
    """The digests of all texts added so far, in the folder `at`, which all executors share.

    `at`/index holds (digest, keep_id, row, batch), bucketed and sorted by digest: a text
    and the row that stays of it. `at`/seen/batch=... holds (id, row, digest) of every row of a batch. Files
    alone are the truth; the session's catalog only names them, so that any later session opens the same index.

    A batch that was lost half way is added again under its name: rows that were written
    whole are not read again, digests that the index has by then are not appended twice.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, at: str, id_type: T.DataType | None = None, buckets: int = BUCKETS):
        self.spark, self.at, self.id_type = spark, at, id_type or T.LongType()
        self.name = "weft_index_" + hashlib.sha256(at.encode()).hexdigest()[:16]
        self.buckets = self._stored_buckets() or buckets
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id {self.id_type.simpleString()}, row BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}/index'"
            )

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        found, system = self._path(path)
        return system.exists(found)

    def _stored_buckets(self) -> int | None:
        """The number of buckets an index there was made with: kept in a file beside it, since files of buckets don't tell."""
        shape = T.StructType([T.StructField("buckets", T.IntegerType())])
        if self._exists(f"{self.at}/shape"):
            return self.spark.read.schema(shape).json(f"{self.at}/shape").first()["buckets"]
        return None

    def known(self) -> DataFrame:
        """(digest, keep_id, row, batch): a row for each distinct text."""
        return self.spark.table(self.name)

    def seen(self, batch: str | None = None) -> DataFrame:
        """(id, row, digest, batch) of the rows of a batch, of all if none is named."""
        shape = T.StructType([T.StructField("id", self.id_type), T.StructField("row", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("batch", T.StringType())])
        if batch is None:
            return self.spark.read.schema(shape).parquet(f"{self.at}/seen")
        return self.spark.read.schema(T.StructType(shape.fields[:3])).parquet(f"{self.at}/seen/batch={batch}").withColumn("batch", F.lit(batch))

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds the texts of a batch. Null texts count as empty; of equal texts that the index lacks the row with the largest id stays, null ids last."""
        if not self._exists(f"{self.at}/shape"):
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{self.at}/shape")
        to = f"{self.at}/seen/batch={batch}"
        if not self._exists(f"{to}/_SUCCESS"):
            digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
            rows = docs.select(F.col(id_col).cast(self.id_type).alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"))
            rows.write.mode("overwrite").parquet(to)
        stays = F.max(F.struct(F.col("id").isNotNull().alias("has"), F.col("id"), F.col("row")))
        own = settle(self.seen(batch).groupBy("digest").agg(stays.alias("_stays")))  # else the anti-join is pushed below, to all rows of a text
        fresh = own.join(self.known().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("_stays.id").alias("keep_id"), F.col("_stays.row").alias("row"), F.lit(batch).alias("batch")).write.format("parquet").bucketBy(
            self.buckets, "digest"
        ).sortBy("digest").mode("append").saveAsTable(self.name)

    def decided(self, batch: str | None = None) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) for every row of a batch, or of all: which row of its text stays, how many rows of all batches have it.

        Sizes and decisions are one row a digest before rows meet them. The few digests that hold more than SHARE of
        all rows are met by broadcast, so that no task gets all rows of one text.
        """
        all_rows = self.seen()
        sizes = all_rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = self.known().select("digest", "keep_id", F.col("row").alias("_row"), F.col("batch").alias("_batch")).join(sizes.hint("merge"), "digest")
        most = max(1.0, SHARE * all_rows.count())
        rows, large = self.seen(batch), F.broadcast(groups.where(F.col("group_size") > most))
        met = rows.join(large, "digest").unionByName(
            rows.join(large, "digest", "left_anti").join(groups.where(F.col("group_size") <= most).hint("merge"), "digest")
        )
        kept = (F.col("row") == F.col("_row")) & (F.col("batch") == F.col("_batch"))
        return met.select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def exact_duplicates(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row for each row of docs; an index is made in the folder `at`.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest id stays, null ids last; of rows that repeat an id and a text one stays,
    whichever. Other columns are not read, whatever their names. An empty table gives an empty result.

    docs is added in `parts` ranges of its (numeric) ids, largest ids first, as a corpus is that
    arrives piece by piece: what an earlier piece has made stand drops its copies in all later ones.
    """
    index = DigestIndex(docs.sparkSession, at, docs.schema[id_col].dataType, buckets)
    cuts = docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    for k, (high, low) in enumerate(zip(edges, edges[1:], strict=False)):
        own = F.lit(True)
        if high is not None:
            own = own & ((F.col(id_col) <= high) | F.col(id_col).isNull())
        if low is not None:
            own = own & (F.col(id_col) > low)
        index.add(docs.where(own), f"part-{k:04d}", id_col, text_col)
    return index.decided().withColumnsRenamed({"id": id_col, "digest": "text_sha256"})


ORACLE = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
