"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's set of word shingles is hashed once; documents with equal sets
   form a class, and classes go on alone. A class keeps the k smallest hashes: its
   bottom-k sketch (of small sets the whole set).
2. Inverted lists hold for each retained value the classes that retain it. Classes
   order their values by how many classes share them and enter only their rarest
   ones: two sketches with `overlap` values in common also share one of the first
   size - overlap + 1 of each, so that a passage which many documents share makes
   no list unless it makes up most of them.
3. Short lists give all their pairs. In a long list every class is first compared
   with a few classes of the list that all its members agree on; what these links
   have joined needs no more comparing. Long lists whose classes are still in
   different components are pooled with those they share classes with, and what of
   a pool is outside its largest component is compared with all of it, block by
   block on the full sets. No pair is capped.
4. The union sketch of a pair estimates its similarity; pairs that may reach the
   threshold are confirmed on the full sets.
5. Links join classes to components, and each is named by its smallest id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.common import settle
from weftspark.llm.components import components
from weftspark.llm.textnum import shingle_sets

K = 64
#: Standard deviations that a sketch may fall short of its expectation.
SLACK = 4.5
#: A list of more classes is long; leaders: classes that the members of a long list are compared with first.
LONG, LEADERS = 16, 6
#: Classes and shingles that a block of a pool has about.
POOL_ROWS, POOL_SHINGLES = 256, 200_000
#: Rows that a task hashes at once.
SLICE = 250
#: Parts that the classes of a pool are dealt to when they learn the pool's facts.
SALT = 32


def least_overlap(size: int, k: int, similarity: float) -> int:
    """Values that the sketch of a set of `size` has in common with that of a similar enough set, all but surely."""
    if size <= similarity * k:
        return math.ceil(size * similarity - 1e-9)
    kept = min(size, k)
    return max(1, math.floor(similarity * kept - SLACK * math.sqrt(kept * similarity * (1 - similarity))))


def _digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two numbers."""
    both = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def sketched(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(_id, n, cls, alt, sketch) of docs (_id, _text): n the set's size, cls and alt a 128-bit digest of the set (null when empty)."""
    out = T.StructType(
        [
            docs.schema["_id"],
            T.StructField("n", T.LongType()),
            T.StructField("cls", T.LongType()),
            T.StructField("alt", T.LongType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(1), words)
                digest = [_digest(s) if len(s) else (None, None) for s in sets]
                heads = [s[:k] for s in sets]
                flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                ends = np.cumsum([0, *(len(h) for h in heads)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in digest], pa.int64()),
                        pa.array([b for _, b in digest], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                    ],
                    names=out.names,
                )

    return docs.mapInArrow(run, out)


def _estimate(k: int):
    """Similarity as the union sketch of two sketches a, b shows it."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
            union, count = np.unique(np.concatenate([x, y]), return_counts=True)
            out[i] = (count[:k] == 2).mean()
        return pd.Series(out)

    return estimate


def _shared():
    """Size of the intersection of two sets, given as sorted 64-bit numbers in binary."""

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            found.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
        return pd.Series(found)

    return shared


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, set) of docs (cls, first, alt, _text): the sorted hashes of the whole set in binary, of texts that belong to cls."""
    out = T.StructType([T.StructField("cls", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(3), words)
                named = zip(*(part.column(i).to_pylist() for i in range(3)), sets, strict=True)
                own = [(c, s.tobytes()) for c, a, b, s in named if _digest(s) == (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())],
                    names=out.names,
                )

    return docs.mapInArrow(run, out).dropDuplicates(["cls"])


def _pool_links(pooled: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of pooled (cls, n, root, pool) and sets (cls, set): links that join what all links within the pools would join.

    The classes of a pool outside its largest component, and those inside, are dealt
    to blocks by hash; each outer block meets every block of the pool in a group of its own.
    A group reports a spanning forest of its links between different roots. A pool's
    facts meet its classes salted, and sets come to the groups by class, so no task holds a pool.
    """
    pooled = pooled.withColumn("salt", F.pmod(F.xxhash64(F.lit(31), "cls"), F.lit(SALT)))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    members = pooled.groupBy("pool", "root").agg(F.count("*").alias("m"))
    major = members.groupBy("pool").agg(F.max_by("root", F.struct("m", "root")).alias("major"))
    rows = pooled.join(salted(major), ["pool", "salt"]).withColumn("outer", F.col("root") != F.col("major")).drop("major")
    sizes = rows.groupBy("pool").agg(
        *[
            F.ceil(
                F.greatest(
                    F.sum(F.when(own, 1).otherwise(0)) / POOL_ROWS, F.sum(F.when(own, F.col("n")).otherwise(0)) / POOL_SHINGLES
                )
            ).alias(name)
            for name, own in (("outs", F.col("outer")), ("ins", ~F.col("outer")))
        ]
    )
    rows = rows.join(salted(sizes), ["pool", "salt"])
    spread = F.xxhash64(F.lit(23), "cls")
    block = F.when(F.col("outer"), F.pmod(spread, "outs")).otherwise(F.pmod(spread, F.greatest("ins", F.lit(1))))
    meets = lambda last: F.sequence(F.lit(0).cast("long"), last - 1)
    pair = lambda i, j, kind: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    groups = F.when(
        F.col("outer"),
        F.concat(
            F.transform(meets(F.col("outs")), lambda j: pair(F.least("block", j), F.greatest("block", j), 0)),
            F.when(F.col("ins") > 0, F.transform(meets(F.col("ins")), lambda j: pair(F.col("block"), j, 1))).otherwise(
                F.array().cast("array<struct<kind:int,i:bigint,j:bigint>>")
            ),
        ),
    ).otherwise(F.transform(meets(F.col("outs")), lambda j: pair(j, F.col("block"), 1)))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        often = count[which] > 1
        owner, which = owner[often], column[which[often]]
        by = np.argsort(which, kind="stable")
        owner, which = owner[by], which[by]
        both = np.zeros((len(sets), len(sets)), np.float64)
        for low in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
            a, b = np.searchsorted(which, [low, low + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], which[a:b] - low] = 1
            both += part @ part.T
        roots = pdf["root"].to_numpy()
        near = 100 * both >= round(similarity * 100) * (size[:, None] + size - both)
        near &= roots[:, None] != roots
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        names = pdf["cls"].to_numpy()
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return (
        rows.withColumn("block", block)
        .select("pool", "cls", "root", F.explode(groups).alias("g"))
        .join(sets, "cls")
        .groupBy("pool", "g")
        .applyInPandas(forest, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.85,
    words: int = 5,
    k: int = K,
) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id, kept), one row for each row of docs.

    class_id is the smallest id among documents with the same set, component_id the
    smallest id reachable over links, kept whether the row's id is that. Empty sets
    link with nothing and keep their own id. Repeated rows are copies of one another;
    rows with a null id take part and never name a component that has other ids. Null
    texts are empty, and texts of any length are read whole. Columns other than the two named are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketches = settle(sketched(rows, words, k))
    classes = sketches.where("cls is not null").groupBy("cls", "alt").agg(
        F.min("_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")
    )
    classes = settle(classes.withColumn("first", F.col("cls")))
    # different sets whose first 64 bits are the same: hardly ever any; all but one take another name
    twins = classes.groupBy("cls").agg(F.count("*").alias("m"), F.min("alt").alias("kept")).where("m > 1").select("cls", "kept")
    if not twins.isEmpty():
        name = F.when(F.col("kept") != F.col("alt"), F.xxhash64("cls", "alt")).otherwise(F.col("cls"))
        renamed = lambda df: df.join(twins, "cls", "left").withColumn("cls", name).drop("kept")
        classes, sketches = settle(renamed(classes)), settle(renamed(sketches))
    limit = F.lit(int(round(similarity * 100)))
    prefix = {s: min(s, k) - least_overlap(s, k, similarity) + 1 for s in range(1, k + 1)}
    fit = lambda x, y: (F.lit(100) * F.least(x, y) >= limit * F.greatest(x, y))

    # inverted lists of the values that two classes at least retain
    kept = F.array(*[F.lit(prefix[s]) for s in range(1, k + 1)])
    values = classes.select("cls", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    by_rarity = Window.partitionBy("cls").orderBy("df", "v")
    index = (
        values.join(often, "v")
        .withColumn("at", F.row_number().over(by_rarity))
        .withColumn("alone", F.col("s") - F.count("*").over(Window.partitionBy("cls")))
        .where(F.col("at") + F.col("alone") <= F.element_at(kept, F.col("s")))
        .select("v", "cls", "n", "at")
    )
    index = settle(index)
    size = index.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    listed = settle(index.join(size, "v"))
    short = listed.where(F.col("m") <= LONG).select("v", "cls", "n")
    long = listed.where(F.col("m") > LONG)
    other = short.select("v", F.col("cls").alias("b"), F.col("n").alias("nb"))
    pairs = (
        short.withColumnRenamed("cls", "a")
        .join(other, "v")
        .where((F.col("a") < F.col("b")) & fit(F.col("n"), F.col("nb")))
        .select("a", "b")
    )

    # long lists: each class meets the leaders of two of its lists; the order by hash makes lists agree on leaders
    order = Window.partitionBy("v").orderBy(F.xxhash64(F.lit(11), "cls"), "cls")
    leaders = (
        long.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= LEADERS)
        .select("v", F.col("cls").alias("b"), F.col("n").alias("nb"))
    )
    few = long.withColumn("turn", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("m"), "v"))).where(
        "turn <= 2"
    )
    stars = (
        few.join(leaders, "v")
        .where((F.col("cls") != F.col("b")) & fit(F.col("n"), F.col("nb")))
        .select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"))
    )

    def sets_of(asked: DataFrame) -> DataFrame:
        """(cls, set) of the classes asked for."""
        chosen = classes.join(asked.distinct(), "cls", "left_semi").select("cls", "first", "alt", F.col("rep").alias("_id"))
        texts = chosen.join(rows, chosen["_id"].eqNullSafe(rows["_id"])).select("cls", "first", "alt", "_text")
        return _full_sets(texts, words)

    def confirmed(candidates: DataFrame) -> DataFrame:
        """The pairs (a, b) of candidates whose full sets are similar enough."""
        half = classes.select("cls", "n", "sketch")
        likely = (
            candidates.distinct()
            .join(half.toDF("a", "na", "sa"), "a")
            .join(half.toDF("b", "nb", "sb"), "b")
            .withColumn("guess", _estimate(k)("sa", "sb"))
            .where(
                F.col("guess")
                >= similarity
                - F.when(F.greatest("na", "nb") <= similarity * k, 1e-9).otherwise(
                    SLACK * math.sqrt(similarity * (1 - similarity) / k)
                )
            )
            .select("a", "b", "na", "nb")
        )
        likely = settle(likely)
        sets = settle(sets_of(likely.select(F.col("a").alias("cls")).union(likely.select("b"))))
        return (
            likely.join(sets.toDF("a", "xa"), "a")
            .join(sets.toDF("b", "xb"), "b")
            .withColumn("both", _shared()("xa", "xb"))
            .where(100 * F.col("both") >= limit * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b")
        )

    links = settle(confirmed(pairs.union(stars)))
    found = settle(components(links))

    # classes of long lists that no path joins yet
    placed = long.select("v", "cls", "n").join(found.toDF("cls", "root"), "cls", "left")
    placed = placed.withColumn("root", F.coalesce("root", "cls"))
    apart = placed.select("v", "root").distinct().groupBy("v").count().where("count > 1").select("v")
    placed = settle(placed.join(apart, "v", "left_semi"))
    if not placed.isEmpty():
        first = placed.groupBy("v").agg(F.min("cls").alias("a"))
        pools = components(placed.join(first, "v").select("a", F.col("cls").alias("b"))).toDF("cls", "pool")
        pooled = settle(placed.select("cls", "n", "root").distinct().join(pools, "cls"))
        sets = settle(sets_of(pooled.select("cls")))
        more = settle(_pool_links(pooled, sets, similarity))
        found = settle(components(links.union(more)))

    named = (
        classes.select("cls", "rep")
        .join(found.toDF("cls", "root"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("cls", "rep", "component_id")
    return (
        sketches.select("_id", "n", "cls")
        .join(named, "cls", "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("rep", "_id").alias("class_id"),
            F.coalesce("component_id", "_id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
