"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt to shards by hash. In each shard a graph is grown in rounds: a
greedy beam search from the entry point proposes neighbours for a block of vectors,
relaxed distance pruning keeps those that no kept one is much nearer to, and edges
are added back and pruned again. Largest inner product becomes smallest distance by
one added coordinate, sqrt(M^2 - |x|^2) with the shard's largest norm M, which is 0
for queries. Every shard answers every query by beam search; the best of all shards
are ranked on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.common import settle

DEGREE, BEAM, RELAX = 24, 64, 1.2
#: Distinct vectors a shard has about, and queries that are searched at once.
SHARD = 8192
SEARCH_BEAM = 96


def _distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances less |query|^2 of queries[i] from points[ids[i]]; an id of -1 is infinitely far."""
    near = norms[ids] - 2 * np.einsum("bkd,bd->bk", points[ids], queries)
    return np.where(ids < 0, np.inf, near)


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """(n, beam) ids nearest first, -1 beyond the last: all queries walk the graph together."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    ids[:, : len(entry)] = entry[:beam]
    far = _distances(points, norms, queries, ids)
    done = np.zeros((n, beam), bool)
    open_rows = np.arange(n)
    while len(open_rows):
        i, d, seen = ids[open_rows], far[open_rows], done[open_rows]
        waiting = np.where(seen | (i < 0), np.inf, d)
        turn = np.argpartition(waiting, min(3, beam - 1), axis=1)[:, :4]
        live = np.isfinite(np.take_along_axis(waiting, turn, 1))
        going = live.any(1)
        open_rows, i, d, seen, turn, live = open_rows[going], i[going], d[going], seen[going], turn[going], live[going]
        if not len(open_rows):
            break
        np.put_along_axis(seen, turn, np.take_along_axis(seen, turn, 1) | live, 1)
        step = np.where(live, np.take_along_axis(i, turn, 1), 0)
        fresh = np.where(live[:, :, None], graph[step], -1).reshape(len(open_rows), -1)
        all_ids = np.concatenate([i, fresh], 1)
        order = np.argsort(all_ids, axis=1, kind="stable")
        ranked = np.take_along_axis(all_ids, order, 1)
        again = np.zeros_like(all_ids, bool)
        np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh = np.where(again[:, beam:], -1, fresh)
        all_ids[:, beam:] = fresh
        all_far = np.concatenate([d, _distances(points, norms, queries[open_rows], fresh)], 1)
        all_seen = np.concatenate([seen, np.zeros_like(fresh, bool)], 1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[open_rows] = np.where(np.isfinite(np.take_along_axis(all_far, best, 1)), np.take_along_axis(all_ids, best, 1), -1)
        far[open_rows] = np.take_along_axis(all_far, best, 1)
        done[open_rows] = np.take_along_axis(all_seen, best, 1)
    return ids


def prune(points: np.ndarray, norms: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """(n, degree) of the candidates near[i] of own[i]: nearest first, without those that a kept one is RELAX times nearer to."""
    near = np.where(near == own[:, None], -1, near)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    far = _distances(points, norms, points[own], near) + norms[own][:, None]
    order = np.argsort(far, axis=1, kind="stable")
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    vectors = points[near]
    between = norms[near][:, :, None] + norms[near][:, None, :] - 2 * np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
    alive = np.isfinite(far)
    kept = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        kept[:, k] = np.where(some, near[rows, first], -1)
        alive &= ~some[:, None] | (relax * between[rows, first] > far)
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry) over points: (n, degree) ids with -1 for no edge, and where searches begin."""
    n = len(points)
    norms = (points**2).sum(1)
    rng = np.random.default_rng(seed)
    middle = norms - 2 * points @ points.mean(0)
    entry = np.array([int(middle.argmin())])
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for power in (1.0, relax):
        order = rng.permutation(n)
        at, block = 0, 64
        while at < n:
            own = order[at : at + block]
            at, block = at + block, min(512, block * 2)
            found = beam_search(points, norms, graph, entry, points[own], beam)
            graph[own] = prune(points, norms, own, np.concatenate([found, graph[own]], 1), degree, power)
            # edges back: each target gets the vectors that now point to it, and is pruned again
            source = np.repeat(own, degree)
            target = graph[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            hit, first, count = np.unique(target, return_index=True, return_counts=True)
            by = np.argsort(count, kind="stable")
            hit, first, count = hit[by], first[by], count[by]
            low = 0
            while low < len(hit):  # groups of about equal size of the arrays that pruning makes
                high = low + max(1, 4_000_000 // (degree + int(count[min(len(hit), low + 512) - 1])) ** 2)
                h, f, c = hit[low : min(high, low + 512)], first[low : min(high, low + 512)], count[low : min(high, low + 512)]
                low += len(h)
                width = int(c.max())
                place = f[:, None] + np.arange(width)
                more = np.where(np.arange(width) < c[:, None], source[np.minimum(place, len(source) - 1)], -1)
                both = np.concatenate([graph[h], more], 1)
                crowded = (both >= 0).sum(1) > degree
                packed = -np.sort(-both, axis=1)[:, :degree]
                graph[h[~crowded]] = packed[~crowded]
                if crowded.any():
                    graph[h[crowded]] = prune(points, norms, h[crowded], both[crowded], degree, power)
    return graph.astype(np.int32), entry


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of vectors with the largest inner products, for each row of queries.

    A query's own id is no candidate of its. Null, all-zero and not finite vectors take
    no part, nor do null ids; of rows that repeat an id the first by vector counts.
    Vectors meet those of their own dimension, each in its own shards. Equal vectors
    are one point of the graph, with the k + 1 smallest of their ids, which is all that
    k neighbours can need. Fewer than k candidates give all of them. Empty tables give
    an empty result.

    Each shard's index is moved once, to the task that answers for it; queries are sent to every shard and pass it in batches.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(vector_col, lambda x: x.cast("double"))
        rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
        finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    rows = clean(vectors)
    rows = rows.select("id", "v", F.xxhash64("v").alias("h"))
    by_id = Window.partitionBy("h", "v").orderBy("id")
    points = (
        rows.withColumn("r", F.row_number().over(by_id))
        .where(F.col("r") <= k + 1)
        .groupBy("h", "v")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    points = settle(points)
    dims = points.groupBy(F.size("v").alias("d")).count()
    dims = settle(dims.select("d", F.greatest(F.lit(1), F.round(F.col("count") / shard)).cast("int").alias("shards")))  # a row for each dimension
    shards = dims.agg(F.sum("shards")).first()[0] or 1
    name = F.concat_ws("-", "d", F.pmod("h", F.col("shards")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        x = np.stack(pdf.v.to_numpy())
        squares = (x**2).sum(1)
        lifted = np.concatenate([x, np.sqrt(squares.max() - squares)[:, None]], 1).astype(np.float32)
        graph, entry = build(lifted)
        ids = pdf.ids.to_numpy()
        return pd.DataFrame(
            {
                "shard": [pdf.shard.iloc[0]],
                "points": [lifted.tobytes()],
                "graph": [graph.tobytes()],
                "entry": [int(entry[0])],
                "sizes": [np.array([len(i) for i in ids], np.int32).tobytes()],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()],
                "exact": [x.tobytes()],
            }
        )

    index = settle(
        points.join(F.broadcast(dims), F.size("v") == F.col("d"))
        .select(name.alias("shard"), "v", "ids", F.element_at("ids", 1).alias("first"))
        .repartition(4 * shards, "shard")  # a shard is little data and much work, so small partitions must not be joined
        .groupBy("shard")
        .applyInPandas(grow, "shard string, points binary, graph binary, entry int, sizes binary, ids binary, exact binary")
    )
    asked = clean(queries).join(F.broadcast(dims), F.size("v") == F.col("d"))
    asked = asked.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(F.concat_ws("-", "d", "h").alias("shard"), "id", "v")

    def answered(row: pd.Series, left: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one shard for some queries."""
        q, own = np.stack(left.v.to_numpy()), left.id.to_numpy()
        dim = q.shape[1]
        x = np.frombuffer(row.points, np.float32).reshape(-1, dim + 1)
        exact = np.frombuffer(row.exact, np.float64).reshape(-1, dim)
        graph = np.frombuffer(row.graph, np.int32).reshape(len(x), -1)
        sizes, ids = np.frombuffer(row.sizes, np.int32), np.frombuffer(row.ids, np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        norms = (x**2).sum(1)
        out = []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            lifted = np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32)
            found = beam_search(x, norms, graph, np.array([row.entry]), lifted, max(beam, k + 1))[:, : k + 1]
            a, b = np.nonzero(found >= 0)
            hit = found[a, b]
            score = np.einsum("ij,ij->i", part[a], exact[hit])
            size = sizes[hit]
            member = np.repeat(edges[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            one = pd.DataFrame({"query_id": np.repeat(own[at + a], size), "id": ids[member], "score": np.repeat(score, size)})
            one = one[one.query_id != one.id].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
            out.append(one.groupby("query_id").head(k))
        return pd.concat(out)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each shard the index comes first, then its queries."""
        index = None
        for batch in batches:
            for shard_, rows in batch.groupby("shard", sort=False):
                first = rows[rows.points.notna()]
                if len(first):
                    index = first.iloc[0]
                rows = rows[rows.points.isna()]
                if len(rows) and index is not None and index.shard == shard_:
                    yield answered(index, rows)

    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in index.columns if c != "shard"]
    both = index.select(F.lit(0).alias("late"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), *index.columns).unionByName(
        asked.select(F.lit(1).alias("late"), F.col("id").cast("long").alias("id"), "v", "shard", *none)
    )
    both = both.repartition(4 * shards, "shard").sortWithinPartitions("shard", "late", "id")
    found = both.mapInPandas(answer, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
