"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import settle

#: Links that a task of a round has about.
TASK_LINKS = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): for each node of a link the smallest node of its component.

    Each round hangs the larger neighbours of every node on its smallest one, then
    the smaller ones; it ends when every node hangs on a root, after about log2 of
    the longest chain rounds; more than `rounds` are an error. Minima are pre-aggregated before the shuffle and joined
    back, so a node with very many links is never gathered in one group. Rounds run
    in as many tasks as the counted links need, so that few links do not make many
    small files. Self links and nulls are dropped; an empty table gives an empty result.
    """
    edges = settle(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state, count = None, edges.count()
    for _ in range(rounds):
        tasks = max(1, -(-count // TASK_LINKS))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = settle(
            small.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, count = now, now[0]
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
