"""Dropping lines that many documents share, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import SPACES, ascii_lower, settle


def line_keys(text: Column) -> Column:
    """The key of each line of a text."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def _hashed(key: Column, min_chars: int) -> Column:
    """128 bits of a line's key in two seeds; null for keys that are too short to count."""
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 10,
    min_chars: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Drops the lines whose key is in at least `threshold` documents, wherever they stand.

    Returns (id_col, *keep, n_lines, n_dropped, kept_text), one row for each row of
    docs. A line's key is the line without white space at its ends, A-Z lower-cased;
    keys of fewer than min_chars code points are never dropped. Lines split at \\n
    alone; null and empty texts are one empty line. Documents are counted by id, so
    repeated rows count once; a null id is one document. Other columns are not read,
    whatever their names. An empty table gives an empty result.

    Hashes of lines are shuffled, not lines: once to be counted, each document's line once,
    and once with their positions to meet the hashes that are common. The texts move once,
    to meet the positions that they lose. A row is known by a 128-bit digest of its id and
    text, so that null ids don't meet in one task; all is linear in the lines of a text.
    """
    keep = keep or []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.xxhash64(F.col(id_col), text).alias("_k1"),
        F.xxhash64(F.lit(2), F.col(id_col), text).alias("_k2"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    split = F.split("_text", "\n", -1)
    lines = rows.select("_id", "_k1", "_k2", F.posexplode(F.transform(line_keys(F.col("_text")), lambda x: _hashed(x, min_chars))).alias("_pos", "_line"))
    lines = lines.where(F.col("_line").isNotNull()).select("_id", "_k1", "_k2", "_pos", "_line.h", "_line.g")
    present = lines.select("_id", "h", "g").distinct()
    frequent = present.groupBy("h", "g").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= threshold)
    frequent = settle(frequent.select("h", "g"))  # else the join takes over the grouping's partitions, which Spark can't split where one line is in very many documents
    lost = lines.join(frequent, ["h", "g"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_lost"))
    joined = rows.join(lost, ["_k1", "_k2"], "left").withColumn("_lines", split)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS pos) u),
often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k)
GROUP BY doc_id
"""
