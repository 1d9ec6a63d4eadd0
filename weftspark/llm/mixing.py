"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quality weights are raised to this much at least; it bounds how uneven the key buckets are.
LEAST_WEIGHT = 0.25


def targets(sizes: DataFrame, shares: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row a source.

    Sources by code point, null last, weigh shares[0], shares[1], ..., repeating; they
    divide the sum of all sizes by weight, and what exceeds `most` times a source's
    size goes to the others by weight, until none is above. That is the level at which
    sum(least(most * size, level * weight)) is the whole: sources fill up in the order
    of most * size / weight. This table has one row for each source, so its two windows
    see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", "_n")
    weights = F.array(*[F.lit(x) for x in shares])
    return (
        sizes.withColumn("_n", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(weights, ((F.col("_n") - 1) % len(shares) + 1).cast("int")))
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_open"))
        .withColumn("_level", F.when(F.col("_fill") >= F.col("_level"), F.col("_level")))
        .withColumn(
            "_level",
            F.first("_level", ignorenulls=True).over(
                by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .select(
            "source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target")
        )
    )


def mix_sources(
    docs: DataFrame,
    size: Column,
    weight: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    shares: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    buckets: int = 4096,
    seed: str = "mix",
) -> DataFrame:
    """(id_col, source, size, source_size, target, epochs, taken), one row for each row of docs.

    Every source gets a target (see targets). Its complete epochs take every document
    that many times; the rest of the target is filled in the order of the keys
    -ln(u) / weight (u uniform, from a digest of seed and id), so a document's chance
    to come early grows with its quality weight, as far as the running sum of sizes
    stays within the rest. The document at the border gives as many words as still
    fit, so a source's words meet its target to within one.

    A running sum over a whole source would put a hot source in one task. Keys are
    dealt to buckets of a source in key order; bucket sums are added up first, and
    only rows of one bucket are sorted together. Weights below LEAST_WEIGHT count as
    that. Null ids and sources are values of their own, null sizes are 0, repeated rows count each; ties in the
    key go by id, then size. Other columns are not read. An empty table gives an
    empty result.
    """
    w = F.greatest(F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(1.0)).cast("double"), F.lit(LEAST_WEIGHT))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        (-F.log(u) / w).alias("_key"),
    ).withColumn("_bucket", F.floor((1 - F.exp(-LEAST_WEIGHT * F.col("_key"))) * buckets))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    goal = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), shares, most)
    in_order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    goal = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(in_order), F.lit(0)))
        .join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "target")
    )
    in_bucket = (
        Window.partitionBy("source", "_bucket").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    epochs = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    ).otherwise(0)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return (
        rows.join(goal, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_run", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)) + F.col("_before"))
        .withColumn("epochs", epochs.cast("long"))
        .select(
            F.col("_id").alias(id_col),
            "source",
            "size",
            "source_size",
            "target",
            "epochs",
            (
                F.col("epochs") * F.col("size")
                + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_run")))
            ).cast("long").alias("taken"),
        )
    )


ORACLE = r"""
WITH sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
           / coalesce(CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END, 1.0) AS k
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
named AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
caps AS (SELECT *, (n - 1) % 3 + 1 AS w, 3 * source_size AS cap, 3 * source_size / ((n - 1) % 3 + 1) AS fill FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY fill, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM caps),
level AS (SELECT lv FROM levels WHERE fill >= lv ORDER BY fill, n LIMIT 1),
goal AS (SELECT source, source_size, least(cap::DOUBLE, lv * w) AS target FROM caps, level),
run AS (
  SELECT s.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(floor(g.target / g.source_size), 3) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM run
"""
