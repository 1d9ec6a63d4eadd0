"""Benchmark passages in documents, edited ones too.

The words of an item and those of item-sized windows of a document are compared by
edit distance. A CGK embedding - a walk over the words whose steps are random bits
of position and word - maps it to Hamming distance; keys of a few sampled positions
of the walk are looked up among those of the items, again and again, so
that an item at its full number of allowed edits is proposed with a chance of about
RECALL: the number of walks grows with that number, see walks_for. Proposals are
verified by the exact edit distance. Each walk is sampled SAMPLES times.

Only windows that can be within the distance are embedded: an edit destroys at most
three of an item's word triples, so a window with fewer of any one item's triples
than that leaves is none. This count filter loses nothing. Items of fewer than LEAST
words allow no edits and are looked up as they are, if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.textnum import Words, mix

#: Share of an item's words that may be edited, and the fewest words of an item that is embedded.
EDITS, LEAST = 0.2, 5
SAMPLES, SAMPLED = 6, 3
#: Chance to propose an item at its full number of edits.
RECALL = 0.99
#: A walk misses an item at k edits with a chance of at most about exp(-RATE / (k + SPARE)).
RATE, SPARE = 5.0, 4
#: Items of more bytes than that are taken in several passes, so that what a task holds is bounded.
ITEM_BYTES = 8 << 20
#: Rows that a task hashes at once.
SLICE = 250
#: Bytes of windows that a task gathers before it embeds them, of those it cuts at once, and cells of a block of distances.
HELD, CUT, CELLS = 24 << 20, 8 << 20, 1 << 20
#: Pairs of a place or window and an item that are held at once; items that begin alike share triples and keys.
PAIRS = 1 << 20


def allowed(length: int, edits: float = EDITS) -> int:
    return max(0, min(int(edits * length + 1e-9), (length - 3) // 3))


def walks_for(limit: int, recall: float = RECALL) -> int:
    """Walks after which an item with `limit` edits is proposed with a chance of about `recall` at least."""
    return max(1, math.ceil(-math.log(1 - recall) * (limit + SPARE) / RATE))


def embed(symbols: np.ndarray, walk: int, samples: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of rows of symbols, one for each sample: one random walk over each row, read at the sampled steps."""
    n, length = symbols.shape
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], 1).ravel()
    at = np.arange(n) * (length + 1)
    last = at + length
    keys = [np.full(n, walk, np.uint64) for _ in samples]
    bits = padded
    for j in range(max(int(s.max()) for s in samples) + 1):
        if j % 64 == 0:  # 64 more random bits of each word
            bits = mix(padded + np.uint64((walk << 20) + j + 1))
        for k, sample in enumerate(samples):
            if j in sample:
                keys[k] = mix(keys[k] * np.uint64(0x9E3779B97F4A7C15) + padded[at])
        at = np.minimum(at + ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), last)
    return keys


def edit_distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each row of items from a part of the row of texts (0 ends a text), and where that part ends."""
    n, width = texts.shape
    steps = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    row[:, 1:][texts == 0] = 1 << 20
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(1), row.argmin(1)


class Index:
    """The items of one pass: their triples, and for each length the keys of their embeddings."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, recall: float = RECALL, samples: int = SAMPLES, seed: int = 3, short: bool = False):
        words = Words(pa.array(texts, pa.large_string()))
        grams, first = words.grams(3)
        pairs, self.times = np.unique(np.stack([grams, words.row[first].astype(np.uint64)]), axis=1, return_counts=True)
        self.triples, self.triple_item = pairs[0], pairs[1].astype(np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.triples & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        rng = np.random.default_rng(seed)
        self.groups = {}
        sizes = self.length = np.diff(words.offsets)
        self.short = {}
        for length in sorted({int(s) for s in sizes if 0 < s < LEAST}) if short else ():
            own = np.flatnonzero(sizes == length)
            grams, first = words.grams(length)
            keys = grams[np.searchsorted(first, words.offsets[own])]
            order = np.argsort(keys, kind="stable")
            self.short[length] = (keys[order], np.array([ids[i] for i in own])[order])
        for length in sorted({int(s) for s in sizes if s >= LEAST}):
            own = np.flatnonzero(sizes == length)
            symbols = np.stack([words.hashes[words.offsets[i] : words.offsets[i + 1]] for i in own])
            places = [[np.sort(rng.choice(2 * length, SAMPLED, replace=False)) for _ in range(samples)] for _ in range(walks_for(allowed(length, edits), recall))]
            tables = []
            for walk, chosen in enumerate(places):
                for keys in embed(symbols, walk, chosen):
                    order = np.argsort(keys, kind="stable")
                    tables.append((keys[order], order))
            self.groups[length] = (np.array([ids[i] for i in own]), symbols, places, tables, allowed(length, edits))

    def exact(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, item ids) of the items of fewer than LEAST words that rows hold as they are."""
        for length, (keys, ids) in self.short.items():
            grams, first = words.grams(length)
            a, b = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            which, slot = _expand(a, b - a)
            found = np.unique(np.stack([words.row[first[which]], slot]), axis=1)
            yield length, found[0], ids[found[1]]

    def candidates(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, rows, windows, windows with their surroundings) of item-sized windows with enough triples of an item."""
        grams, first = words.grams(3)
        maybe = np.flatnonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(grams) else np.zeros(0, int)
        if not self.groups or not len(maybe):
            return
        a, b = np.searchsorted(self.triples, grams[maybe], "left"), np.searchsorted(self.triples, grams[maybe], "right")
        for low, high in _pieces(b - a, words.row[first[maybe]], PAIRS):
            yield from self._with_items(words, first[maybe[low:high]], a[low:high], b[low:high])

    def _with_items(self, words: Words, places: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """`candidates` of some rows, by ranges of items if there are many pairs: the triples at places[i] are a[i]:b[i] of the index."""
        shares = -(-int((b - a).sum()) // PAIRS)
        starts: dict[int, list] = {}
        for k in range(shares):
            if shares == 1:
                which, slot = _expand(a, b - a)
            else:
                own = np.concatenate([[0], np.cumsum(self.triple_item % shares == k)])  # triples of this range before each place of the index
                which, at = _expand(own[a], own[b] - own[a])
                slot = np.flatnonzero(self.triple_item % shares == k)[at]
            for length, found in self._starts(words, places[which], slot):
                starts.setdefault(length, []).append(found)
        for length, found in starts.items():
            yield from self._cut(words, length, np.unique(np.concatenate(found)))

    def _starts(self, words: Words, hits: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, first words of windows) from places and the triples of items that stand there."""
        hit_item = self.triple_item[slot]
        by = np.argsort(hit_item, kind="stable")
        hits, hit_item, slot = hits[by], hit_item[by], slot[by]
        # of a run of one triple, a window that reaches beyond it has the first or the last ones; more than the item has don't count
        edge = np.flatnonzero(np.diff(slot, prepend=-1) | (np.diff(hits, prepend=-9) != 1))
        size = np.diff(np.append(edge, len(hits)))
        place = np.arange(len(hits)) - np.repeat(edge, size)
        counts = np.minimum(place, np.repeat(size, size) - 1 - place) < self.times[slot]
        hits, hit_item = hits[counts], hit_item[counts]
        hit_row, hit_length = words.row[hits], self.length[hit_item]
        for length in np.unique(hit_length):
            if length not in self.groups:
                continue
            need = length - 2 - 3 * self.groups[length][4]
            own = np.flatnonzero(hit_length == length)
            if len(own) < need:
                continue
            # `need` triples of one item in one window: it starts between the last one's end less the length and the first
            one, last = own[: len(own) - need + 1], own[need - 1 :]
            fit = (hit_item[one] == hit_item[last]) & (hit_row[one] == hit_row[last])
            fit &= hits[last] + 3 - hits[one] <= length
            low, high = hits[last][fit] + 3 - length, hits[one][fit]
            if not len(low):
                continue
            row = words.row[high]
            low = np.maximum(low, words.offsets[row])
            high = np.minimum(high, np.maximum(words.offsets[row + 1] - length, words.offsets[row]))
            spans = np.unique(np.minimum(low, high) << np.int64(32) | high)  # the same for all items that begin alike
            low, high = spans >> np.int64(32), spans & np.int64(0xFFFFFFFF)
            starts = np.unique(_expand(low, high - low + 1)[1])
            yield int(length), starts

    def _cut(self, words: Words, length: int, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        limit, row = self.groups[length][4], words.row[starts]
        end = words.offsets[row + 1][:, None]

        def cut(begin: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
            at = begin[:, None] + np.arange(width)
            return np.where(at < end, words.hashes[np.minimum(at, len(words.hashes) - 1)], np.uint64(0))

        step = max(1, CUT // (16 * (length + limit)))
        for at in range(0, len(starts), step):
            own, stop = starts[at : at + step], end[at : at + step]
            first = np.maximum(own - limit, words.offsets[row[at : at + step]])
            yield int(length), row[at : at + step], cut(own, length, stop), cut(first, length + 2 * limit, stop)

    def verified(self, length: int, windows: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item id, distance) of the windows that LSH proposes for an item and that are within its distance."""
        ids, symbols, places, tables, limit = self.groups[length]
        distinct, same = np.unique(windows, axis=0, return_inverse=True)
        of_window = np.argsort(same, kind="stable")
        first = np.searchsorted(same[of_window], np.arange(len(distinct) + 1))
        keyed = [keys for walk, chosen in enumerate(places) for keys in embed(distinct, walk, chosen)]
        ranges = [(np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")) for (keys, _), own in zip(tables, keyed, strict=True)]
        many = sum(b - a for a, b in ranges)
        out = []
        for low, high in _pieces(many, np.arange(len(distinct)), PAIRS):
            proposed = []
            for (a, b), (_, order) in zip(ranges, tables, strict=True):
                which, slot = _expand(a[low:high], (b - a)[low:high])
                proposed.append(np.unique((which + low) * len(ids) + order[slot]))
            proposed = np.unique(np.concatenate(proposed))
            of, item = proposed // len(ids), proposed % len(ids)
            for x, y in _pieces(np.diff(first)[of], np.arange(len(of)), PAIRS):
                pair, at = _expand(first[of[x:y]], np.diff(first)[of[x:y]])
                which, chosen = of_window[at], item[x:y][pair]
                step = max(1, CELLS // around.shape[1])
                for k in range(0, len(which), step):
                    distance = edit_distances(symbols[chosen[k : k + step]], around[which[k : k + step]])[0]
                    near = distance <= limit
                    out.append((which[k : k + step][near], ids[chosen[k : k + step][near]], distance[near]))
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


def _pieces(sizes: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of places, cut between groups, whose sizes add up to about `most`; a larger group stands alone."""
    if not len(sizes):
        return
    edges = np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(sizes))
    total = np.concatenate([[0], np.cumsum(sizes)])[edges]
    low = 0
    while low < len(edges) - 1:
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        yield int(edges[low]), int(edges[high])
        low = high


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row i its number, count[i] times, and with it first[i], first[i] + 1, ..."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) + np.repeat(first - (np.cumsum(count) - count), count)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    recall: float = RECALL,
    samples: int = SAMPLES,
    item_bytes: int = ITEM_BYTES,
    short: bool = False,
) -> DataFrame:
    """(id_col, item_col, distance, n_words): the items that a document holds, n_words the item's and distance the edits.

    Words are runs of other than white space, A-Z lower-cased. An item is held if a
    part of the text is within allowed(n_words) edits - words put in, left out or
    changed - of it. Items of fewer than LEAST words are no passages unless `short` has
    them looked up as they are; null or empty ones and null ids are none. Null and empty texts hold nothing; repeated rows of an id are one
    document. Other columns are not read. Empty tables give an empty result.

    The items go to every task, at most item_bytes of their texts at once: of a larger
    benchmark each part takes a pass over docs of its own.
    """
    bench = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // item_bytes))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = T.StructType([rows.schema["_id"], *(T.StructField(c, T.LongType()) for c in ("item", "distance", "n_words"))])
    found = None
    for k in range(passes):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).orderBy("item", "text").collect()
        index = Index([r["item"] for r in part], [r["text"] for r in part], edits, recall, samples, short=short)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for length, parts in held.items():
                    rows, windows, around = pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))
                    which, item, distance = index.verified(length, windows, around)
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(which)), pa.array(item), pa.array(distance), pa.array(np.full(len(which), length))], names=out.names
                    )
                held.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(at, SLICE)
                    words = Words(piece.column(1))
                    for length, row, item in index.exact(words):
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(pa.array(row)), pa.array(item), *(pa.array(np.full(len(row), x)) for x in (0, length))], names=out.names
                        )
                    for length, row, windows, around in index.candidates(words):
                        held.setdefault(length, []).append((piece.column(0).take(pa.array(row)), windows, around))
                        size += windows.nbytes + around.nbytes
                        if size > HELD:
                            yield from flush()
                            size = 0
            yield from flush()

        one = rows.mapInArrow(run, out)
        found = one if found is None else found.union(one)
    return found.groupBy("_id", "item").agg(F.min("distance").alias("distance"), F.min("n_words").alias("n_words")).select(
        F.col("_id").alias(id_col), F.col("item").alias(item_col), "distance", "n_words"
    )
