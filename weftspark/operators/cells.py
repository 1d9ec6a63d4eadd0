"""Approximate search by cells: chunks are kept by their nearest centre, and questions look into the nearest cells.

The filter of a question holds inside each cell, before its best chunks are chosen, and
a question goes on to further cells until enough chunks have passed its filter - or, if
exact answers are asked for, until no cell left can hold a nearer one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.state import settle
from weftspark.operators.vectors import ASKED, HELD, ROWS, matching

#: Bound on the sample that centres are fitted on: vectors of the smallest digests.
SAMPLE = 20_000


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v**2).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def centres(chunks: DataFrame, cells: int, rounds: int = 10, sample: int = SAMPLE) -> np.ndarray:
    """Up to `cells` unit vectors by spherical k-means over at most `sample` vectors of chunks (chunk_id, v)."""
    drawn = chunks.where("v is not null").select("v", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(sample).select("v").collect()
    rows = _unit(np.array([r["v"] for r in drawn], np.float64)) if drawn else np.zeros((0, 1))
    rows = rows[(rows != 0).any(1)]
    if not len(rows):
        return np.zeros((0, 1))
    rng = np.random.default_rng(11)
    found = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        near = (rows @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        empty = np.bincount(near, minlength=len(found)) == 0
        sums[empty] = rows[rng.choice(len(rows), int(empty.sum()))]
        found = _unit(sums)
    return found


class Cells:
    """An index of chunks (chunk_id, v, ...): `rows` has them with their cell and part, `sizes` (cell, held, parts, low) a row for each cell.

    low: the least cosine of a chunk with its centre. A cell of more than HELD chunks has
    several parts, so no task holds more of it than that. Chunks without a vector or with one of zeros
    are in no cell; their similarity to anything is 0.
    """

    def __init__(self, chunks: DataFrame, cells: int = 256, rounds: int = 10, sample: int = SAMPLE, held: int = HELD):
        self.centres = found = centres(chunks, cells, rounds, sample)
        self.chunks = chunks

        @F.pandas_udf("cell int, near double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            rows = _unit(np.array(v.tolist(), np.float64)) if len(v) else np.zeros((0, found.shape[1]))
            score = rows @ found.T
            return pd.DataFrame({"cell": score.argmax(1), "near": score.max(1)})

        has = chunks.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
        if not len(found):
            has = has.limit(0)
            placed = has.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("near"))
        else:
            placed = has.withColumn("_c", nearest("v")).select(*chunks.columns, "_c.cell", "_c.near")
        placed = settle(placed)
        parts = F.ceil(F.count("*") / held).cast("int").alias("parts")
        self.sizes = settle(placed.groupBy("cell").agg(F.count("*").alias("held"), parts, F.min("near").alias("low")))
        spread = placed.join(F.broadcast(self.sizes.select("cell", "parts")), "cell")  # a row for each centre
        self.rows = spread.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts", "near")


def _order(questions: DataFrame, index: Cells, exact: bool) -> DataFrame:
    """questions with `cells`: all cells, the nearest first, each with the most that a chunk of it can score; exact: those with the largest such bound first."""
    known = {r["cell"]: r["low"] for r in index.sizes.collect()}  # one row for each centre
    at = np.array(sorted(known), np.int64)
    centre, low = index.centres[at], np.array([known[c] for c in at])
    width = np.arccos(np.clip(low, -1, 1))

    @F.pandas_udf("array<struct<cell:int,most:double>>")
    def order(q: pd.Series) -> pd.Series:
        rows = _unit(np.array(q.tolist(), np.float64))
        near = np.clip(rows @ centre.T, -1, 1)
        most = np.cos(np.maximum(0, np.arccos(near) - width)) + 1e-9
        by = np.argsort(-(most if exact else near), axis=1, kind="stable")
        return pd.Series([[{"cell": int(at[j]), "most": float(m[j])} for j in row] for row, m in zip(by, most, strict=True)])

    return questions.withColumn("cells", order("q"))


def search(index: Cells, questions: DataFrame, k: int, probes: int = 4, enough: int | None = None, exact: bool = False, extra: list[str] | None = None) -> DataFrame:
    """(qid, rank, chunk_id, score, *extra, seen): the k nearest chunks that each question (qid, q, ...) finds; k <= 0 finds none.

    `wanted` and `clearance` of questions hold as in `vectors.knn`. A question looks into `probes` cells, then into as many
    again as it has, until at least `enough` chunks (4 k unless told) passed its filter or all cells were looked
    into. exact: until no further cell can hold a chunk among the k best, so that answers are
    those of `knn`, but for chunks of zeros. seen: how many chunks were compared with the question. Each round is one join of the open
    questions with their cells; ties go to the smaller chunk_id.
    """
    carry = extra or []
    enough = 4 * k if enough is None else enough
    conditions = [c for c in ("wanted", "clearance") if c in questions.columns]
    fields = [index.rows.schema[c] for c in ("chunk_id", *carry)]
    if k <= 0 or not len(index.centres):
        kinds = [questions.schema["qid"], T.StructField("rank", T.IntegerType()), fields[0], T.StructField("score", T.DoubleType()), *fields[1:], T.StructField("seen", T.LongType())]
        return questions.sparkSession.createDataFrame([], T.StructType(kinds))
    found_type = T.StructType([questions.schema["qid"], *fields, T.StructField("score", T.DoubleType())])
    counted_type = T.StructType([*found_type.fields, T.StructField("passed", T.LongType()), T.StructField("seen", T.LongType())])
    best = matching(found_type, k, None, None, carry, conditions, None)

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k best of each question that meets this part of a cell; a row without a chunk tells how many it saw and how many of them passed."""
        if not len(a):
            return pd.DataFrame({f.name: [] for f in counted_type}).astype({"score": "float64", "passed": "int64", "seen": "int64"})
        near = best(a, b)
        passed = np.zeros(len(a), np.int64)
        codes, labels = pd.factorize(b.label) if "wanted" in conditions else (None, [])
        place = {label: i for i, label in enumerate(labels)}
        r = b.r.to_numpy(np.float64) if "clearance" in conditions else None
        for low in range(0, len(a) if len(b) else 0, ROWS):
            part = a.iloc[low : low + ROWS]
            may = np.ones((len(part), len(b)), bool)
            if "wanted" in conditions:
                for i, wanted in enumerate(part.wanted):
                    if wanted is not None:
                        may[i] = np.isin(codes, [place[x] for x in wanted if x in place])
            if "clearance" in conditions:
                rank = part.clearance.to_numpy(np.float64)[:, None]
                may &= (r <= rank) | np.isnan(rank)
            passed[low : low + ROWS] = may.sum(1)
        told = pd.DataFrame({"qid": a.qid, "passed": passed, "seen": len(b)})
        return pd.concat([near.assign(passed=0, seen=0), told]).reindex(columns=counted_type.names)

    facts = {"wanted": "label", "clearance": "r"}
    held = index.rows.select("cell", "part", *dict.fromkeys(["chunk_id", "v", *carry, *(facts[c] for c in conditions)]))
    sizes = F.broadcast(index.sizes.select("cell", "parts"))
    asked = settle(_order(questions.where("q is not null").select("qid", "q", *conditions), index, exact))
    blocks = max(1, -(-asked.count() // ASKED))  # however many questions look into a cell, a task gets about ASKED of them
    held = held.withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hit = F.struct((-F.col("score")).alias("loss"), "chunk_id", *carry)
    state, at, step = None, 0, max(1, probes)
    while at < len(index.centres):
        open_ = asked if state is None else asked.join(state.where("open").select("qid"), "qid")
        probed = open_.select("qid", "q", *conditions, F.explode(F.slice("cells", F.lit(at + 1), F.lit(step))).alias("c")).select("qid", "q", *conditions, F.col("c.cell").alias("cell"))
        probed = probed.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        probed = probed.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        met = probed.groupBy("cell", "part", "bq").cogroup(held.groupBy("cell", "part", "bq")).applyInPandas(block, counted_type)
        new = met.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), hit))).alias("near"), F.sum("passed").alias("p"), F.sum("seen").alias("s"))
        at, step = at + step, at + step
        next_ = asked.select("qid", F.get("cells", F.lit(at))["most"].alias("most"))
        if state is None:
            both = new.select("qid", F.slice("near", 1, k).alias("hits"), F.col("p").alias("passed"), F.col("s").alias("seen"))
        else:
            both = state.join(new, "qid", "left").select(
                "qid", F.when(F.col("near").isNull(), F.col("hits")).otherwise(F.slice(F.array_sort(F.concat("hits", "near")), 1, k)).alias("hits"),
                (F.col("passed") + F.coalesce("p", F.lit(0))).alias("passed"), (F.col("seen") + F.coalesce("s", F.lit(0))).alias("seen"), F.col("near").isNotNull().alias("going"),
            )
        going = F.lit(True) if state is None else F.col("going")
        worst = -F.get("hits", F.lit(k - 1))["loss"]
        again = (worst.isNull() | (F.col("most") > worst)) if exact else F.col("passed") < enough
        state = settle(both.join(next_, "qid").select("qid", "hits", "passed", "seen", (going & F.col("most").isNotNull() & again).alias("open")))
        if state.where("open").isEmpty():
            break
    rows = state.select("qid", "seen", F.posexplode("hits").alias("place", "h"))
    return rows.select("qid", (F.col("place") + 1).alias("rank"), F.col("h.chunk_id").alias("chunk_id"), (-F.col("h.loss")).alias("score"), *[F.col(f"h.{c}").alias(c) for c in carry], "seen")
