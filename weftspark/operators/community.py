"""Communities of an undirected graph by rounds of local moves on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.state import settle

#: The smallest gain of modularity for which a level goes on, or another one begins.
LEAST_GAIN = 1e-7
#: In how many turns a cycle lets the nodes move at most.
MOST_TURNS = 8


def modularity(member: DataFrame, edges: DataFrame) -> float:
    """Of a partition (id, community) of the graph with edges (src, dst), each pair of nodes linked once; 0 without links."""
    links = _links(member, edges)
    place = member.select(F.col("id"), "community")
    both = links.join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b")
    sums = both.select(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("double").alias("within")).unionByName(both.select(F.col("cb").alias("c"), F.lit(0.0).alias("within")))
    sums = sums.groupBy("c").agg(F.sum("within").alias("within"), F.count("*").alias("k"))
    total, within, squares = sums.agg(F.sum("k") / 2, F.sum("within"), F.sum(F.col("k").cast("double") ** 2)).first()
    return within / total - squares / (4 * total**2) if total else 0.0


def _links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): each linked pair of known nodes once, a < b."""
    known = nodes.select("id")
    pairs = edges.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").where("src <> dst")
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _turn(both: DataFrame, state: DataFrame, double: float, turns: int, turn: int) -> DataFrame:
    """state (a, c, k, own) after the nodes whose turn it is have moved: (a, c, k, own, now, inner).

    c is the community with the largest gain, ties to the smallest name; `now` the one before, `inner`
    the weight of links into it. A node that stands alone joins another one such only if that
    has the smaller name, so that the two don't change places.
    """
    sums = state.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("held"))
    placed = state.join(sums, "c")
    beside = placed.select(F.col("a").alias("b"), "c", "tot", "held")
    toward = both.join(beside, "b").groupBy("a", "c").agg(F.sum("w").alias("w"), F.first("tot").alias("tot"), F.first("held").alias("held"))
    mine = placed.select("a", F.col("c").alias("now"), "k", "own", F.col("tot").alias("own_tot"), F.col("held").alias("beside"))
    stays = F.col("c") == F.col("now")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0)) / double
    may = ~((F.col("beside") == 1) & (F.col("held") == 1) & (F.col("c") > F.col("now"))) & ~stays
    same = [F.first(c).alias(c) for c in ("now", "k", "own", "own_tot")]
    choice = mine.join(toward, "a", "left").withColumn("gain", gain).groupBy("a").agg(
        *same,
        F.min(F.when(may, F.struct((-F.col("gain")).alias("loss"), "c"))).alias("best"),
        F.max(F.when(stays, F.col("gain"))).alias("stay"),
        F.coalesce(F.max(F.when(stays, F.col("w"))), F.lit(0.0)).alias("inner"),
    )
    goes = F.pmod(F.xxhash64("a", F.lit(turn // turns)), F.lit(turns)) == turn % turns
    alone = -F.col("k") * (F.col("own_tot") - F.col("k")) / double  # without a link into its own community a node only weighs on the others there
    better = goes & F.coalesce(-F.col("best.loss") > F.coalesce("stay", alone) + 1e-12, F.lit(False))
    return choice.select("a", F.when(better, F.col("best.c")).otherwise(F.col("now")).alias("c"), "k", "own", "now", "inner")


def _measured(moved: DataFrame, double: float) -> float:
    """The modularity before the turn."""
    sums = moved.groupBy("now").agg(F.sum("k").alias("tot"), F.sum(F.col("inner") + F.col("own")).alias("within"))
    within, squares = sums.agg(F.sum("within"), F.sum(F.col("tot") ** 2)).first()
    return within / double - squares / double**2


def _level(links: DataFrame, double: float) -> tuple[DataFrame, float]:
    """(a, c) of the nodes of links (a, b, w) where no cycle of moves gains LEAST_GAIN any more, and the modularity.

    A cycle has turns in which each node may move once. Nodes of one turn don't see each other's moves, so a cycle may
    lose: then its moves are taken back and the nodes get more turns.
    """
    both = settle(links.where("a <> b").select("a", "b", "w").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    own = links.where("a = b").select("a", (2 * F.col("w")).alias("own"))
    degrees = both.groupBy("a").agg(F.sum("w").alias("k")).join(own, "a", "full")
    state = settle(degrees.select("a", F.col("a").alias("c"), (F.coalesce("k", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("k"), F.coalesce("own", F.lit(0.0)).alias("own")))
    turns, turn, kept, before = 2, 0, state, None
    while True:
        moved = settle(_turn(both, state, double, turns, turn))
        if turn % turns == 0:
            q = _measured(moved, double)
            if before is not None and q < before + LEAST_GAIN:
                if q >= before:
                    return state.select("a", "c"), q
                if turns == MOST_TURNS:
                    return kept.select("a", "c"), before
                turns, turn, state, before = turns * 2, 0, kept, None
                continue
            kept, before = state, q
        state, turn = moved.select("a", "c", "k", "own"), turn + 1


def _connected(links: DataFrame, member: DataFrame) -> DataFrame:
    """(id, community): each community's connected parts, named after their smallest member.

    Parts take the smallest name around them and then that name's own, until nothing changes.
    """
    place = member.toDF("a", "ca")
    inner = links.join(place, "a").join(place.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
    both = settle(inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    name = settle(member.select(F.col("id").alias("a"), F.col("id").alias("c")))
    while True:
        around = both.join(name.toDF("b", "n"), "b").groupBy("a").agg(F.min("n").alias("n"))
        near = name.join(around, "a", "left").select("a", F.least("c", F.coalesce("n", "c")).alias("m"), F.col("c").alias("was"))
        found = settle(near.join(name.toDF("m", "far"), "m").select("a", F.least("m", "far").alias("c"), "was"))
        name = found.select("a", "c")
        if found.where("c <> was").isEmpty():
            return name.toDF("id", "community")


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): every node is covered, isolates stand alone, communities are connected.

    Levels of local moves, each one's communities the nodes of the next, until a level gains
    less than LEAST_GAIN of modularity. Communities that came apart are then split into
    their connected parts, and if any did, levels go on from these. Repeated and self links and
    those to unknown nodes don't count. Weights are whole numbers, ties go by name, turns by hash: the
    result does not depend on partitions or order.
    """
    known = nodes.select("id").distinct()
    first = settle(_links(known, edges))
    total = first.count()
    member = settle(known.select("id", F.col("id").alias("community")))
    if total == 0:
        return member
    while True:
        before = None
        while True:
            place = member.select(F.col("id"), "community")
            links = first.join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b")
            links = settle(links.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").cast("double").alias("w")))
            found, q = _level(links, 2.0 * total)
            member = settle(member.join(found.toDF("community", "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
            if before is not None and q < before + LEAST_GAIN:
                break
            before = q
        parts = _connected(first, member)
        if parts.agg(F.countDistinct("community")).first() == member.agg(F.countDistinct("community")).first():
            return parts
        member = parts


def numbered(member: DataFrame) -> DataFrame:
    """(id, community) with names community-0, ... by size, then first member.

    Communities, which isolates make as many as nodes, are sorted over the cluster by
    range; each range counts its own, and one row a range tells where its numbers begin.
    """
    sizes = member.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    ranged = settle(sizes.repartitionByRange(F.desc("size"), "first").withColumn("part", F.spark_partition_id()))
    own = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "first")))
    begins = ranged.groupBy("part").agg(F.count("*").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begin"))
    names = own.join(F.broadcast(begins), "part").select("community", F.concat(F.lit("community-"), (F.col("begin") + F.col("n") - 1).cast("string")).alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))
