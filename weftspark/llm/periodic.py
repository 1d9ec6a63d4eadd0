"""Runs of words that repeat with a period, found by convolution of blocks.

At each scale L = 1, 2, 4, ... a text's words are cut into blocks of L, and the sum of
squared differences of a block and the words d after it is computed for all d of
L to 2 L - 1 at once: squares by prefix sums, products by a number-theoretic transform,
in whole numbers modulo a prime. Where the sum is zero the block occurs again; the
distance seeds a stretch that is extended as far as words d apart are identical. A
run of four periods holds at least two neighbouring blocks of the scale of its period in
full, so none is missed, and all texts of a batch are worked on as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.textnum import string_buffers

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The prime 3 * 2 ** 30 + 1, whose products fit 64 bits, and a generator: transforms of up to 2 ** 30 words.
PRIME, ROOT = np.uint64(3221225473), 5
#: Bytes of text that are worked on at once (a longer text alone), and cells of a transform.
SLICE, CELLS = 1 << 20, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Text:
    """The words of some texts: `words` as an Arrow array, `code` the same number for identical ones, those of row i at offsets[i]:offsets[i + 1]."""

    def __init__(self, texts: pa.Array):
        raw, at = string_buffers(texts)
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        space = _SPACE[raw]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        first[edges] = ~space[edges]
        last[:-1] &= space[1:]
        last[edges - 1] = ~space[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        between = np.empty(2 * len(start) + 1, np.int64)  # words and what stands between them by turns
        between[:-1:2], between[1::2], between[-1] = start, end, len(raw)
        between[0] = start[0] if len(start) else len(raw)
        all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(between), pa.py_buffer(np.ascontiguousarray(raw))])
        self.words = all_.take(pa.array(np.arange(0, 2 * len(start), 2)))
        self.code = self.words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(start) else np.zeros(0, np.int64)
        self.offsets = np.searchsorted(start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.offsets))


def next_same(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many words after each the same word stands again in its row; a large number where it does not."""
    place = np.sort((code.astype(np.uint64) << np.uint64(32)) | np.arange(len(code), dtype=np.uint64))
    at = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = np.full(len(code), np.iinfo(np.int64).max)
    same = (place[1:] >> np.uint64(32) == place[:-1] >> np.uint64(32)) & (row[at[1:]] == row[at[:-1]])
    out[at[:-1][same]] = (at[1:] - at[:-1])[same]
    return out


_ROOTS: dict[tuple[int, bool], list[np.ndarray]] = {}


def _roots(size: int, back: bool) -> list[np.ndarray]:
    """For each step of a transform of `size`, largest first, the powers that it multiplies by."""
    if (size, back) not in _ROOTS:
        p = int(PRIME)
        steps, n = [], size
        while n > 1:
            w = pow(ROOT, (p - 1) // n, p)
            powers = np.ones(n // 2, np.uint64)
            known, step = 1, pow(w, p - 2, p) if back else w
            while known < n // 2:  # powers double in number
                powers[known : 2 * known] = powers[:known] * np.uint64(pow(step, known, p)) % PRIME
                known *= 2
            steps.append(powers)
            n //= 2
        _ROOTS[size, back] = steps
    return _ROOTS[size, back]


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    count, size = rows.shape
    for powers in _roots(size, False):
        half = len(powers)
        x = rows.reshape(count, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.stack([(a + b) % PRIME, (a + (PRIME - b)) % PRIME * powers % PRIME], 2).reshape(count, size)
    return rows


def transform_back(rows: np.ndarray) -> np.ndarray:
    count, size = rows.shape
    for powers in reversed(_roots(size, True)):
        half = len(powers)
        x = rows.reshape(count, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * powers % PRIME
        rows = np.stack([(a + b) % PRIME, (a + (PRIME - b)) % PRIME], 2).reshape(count, size)
    return rows * np.uint64(pow(size, int(PRIME) - 2, int(PRIME))) % PRIME


def squared_differences(block: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Modulo PRIME the sum of squared differences of each block (of L numbers) and after[d:d + L], for d of 0 to L - 1; after has 2 L - 1 numbers."""
    size = block.shape[1]
    block, after = block.astype(np.uint64) % PRIME, after.astype(np.uint64) % PRIME
    own = (block * block % PRIME).sum(1) % PRIME
    sums = np.zeros((len(after), 2 * size), np.uint64)
    np.cumsum(after * after % PRIME, axis=1, out=sums[:, 1:])
    there = (sums[:, size:] - sums[:, :size]) % PRIME
    padded = np.zeros((2, len(block), 2 * size), np.uint64)
    padded[0, :, :size], padded[1, :, : 2 * size - 1] = block[:, ::-1], after
    products = transform_back(transform(padded[0]) * transform(padded[1]) % PRIME)[:, size - 1 : 2 * size - 1]
    return (own[:, None] + there + (PRIME - products) * np.uint64(2)) % PRIME


def seeds(code: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, distance), by distance and word, of the blocks of `size` at begin that occur again `size` to 2 `size` - 1 words later, before end.

    Left out are those whose neighbours on both sides do not occur at the same distance.
    """
    places, distances, stops = [], [], []
    step = max(1, CELLS // (2 * size))
    for low in range(0, len(begin), step):
        at, stop = begin[low : low + step, None], end[low : low + step, None]
        own = code[at + np.arange(size)] + 1
        later = at + size + np.arange(2 * size - 1)
        after = np.where(later < stop, code[np.minimum(later, len(code) - 1)] + 1, 0)  # 0: no word
        b, d = np.nonzero(squared_differences(own, after) == 0)
        places.append(begin[b + low])
        distances.append(d + size)
        stops.append(end[b + low])
    b, d = np.concatenate(places), np.concatenate(distances)
    inside = b + d + size <= np.concatenate(stops)
    b, d = b[inside], d[inside]
    by = np.lexsort((b, d))
    b, d = b[by], d[by]
    pair = _follows(b, d, size)
    pair = pair | np.append(pair[1:], False)
    b, d = b[pair], d[pair]
    good = np.ones(len(b), bool)
    for low in range(0, len(b), step):  # a sum that is no more than a multiple of the prime is none
        at = b[low : low + step, None] + np.arange(size)
        good[low : low + step] = (code[at] == code[at + d[low : low + step, None]]).all(1)
    return b[good], d[good]


def _follows(b: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Whether each seed's block comes next after that of the seed before it, at the same distance."""
    out = np.zeros(len(b), bool)
    out[1:] = (d[1:] == d[:-1]) & (b[1:] == b[:-1] + size)
    return out


def _reach(code: np.ndarray, at: np.ndarray, distance: np.ndarray, edge: np.ndarray, way: int) -> np.ndarray:
    """How many words from `at` on (way 1, up to edge) or before it (way -1, down to edge) equal those `distance` after them."""
    out, open_, width = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(open_):
        most = max(1, CELLS // width)
        going = []
        for low in range(0, len(open_), most):
            own = open_[low : low + most]
            from_ = at[own] + out[own] if way > 0 else at[own] - out[own] - 1
            room = np.maximum(edge[own] - from_ if way > 0 else from_ - edge[own] + 1, 0)
            steps = np.arange(width)
            where = from_[:, None] + way * steps
            inside = steps < room[:, None]
            where = np.where(inside, where, 0)
            same = inside & (code[where] == code[np.where(inside, where + distance[own][:, None], 1 if len(code) > 1 else 0)])
            more = np.where(same.all(1), width, same.argmin(1))
            out[own] += more
            going.append(own[more == width])
        open_ = np.concatenate(going)
        width = min(width * 2, 1 << 16)
    return out


def runs(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs, by row, start and period; starts count from the row's first word.

    Two tests that lose nothing spare most blocks the convolution. Each word of a stretch stands
    again within its period, so blocks with a word that doesn't are left out, and those without
    a neighbour left. A block inside a run of a shorter period, with all the words that its
    distances reach, can only show multiples of that period.
    """
    code, offsets, n = text.code, text.offsets, np.diff(text.offsets)
    again = next_same(code, text.row)
    covered = np.zeros(len(code), np.int64)  # how far a run that holds the word reaches
    found = []
    size = 1
    while len(n) and LEAST_PERIODS * size <= n.max():
        rows = np.flatnonzero(n >= LEAST_PERIODS * size)
        count = n[rows] // size
        of = np.repeat(np.arange(len(rows)), count)
        number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin, end = offsets[rows][of] + number * size, offsets[rows + 1][of]
        edges = np.stack([begin, begin + size], 1).ravel()
        edges = edges[:-1] if len(edges) and edges[-1] == len(code) else edges
        maybe = np.maximum.reduceat(again, edges)[::2] < 2 * size if len(edges) else np.zeros(0, bool)
        maybe &= covered[begin] < np.minimum(begin + 3 * size - 1, end)
        next_ = np.zeros(len(maybe), bool)
        next_[:-1] = maybe[:-1] & maybe[1:] & (of[:-1] == of[1:])
        maybe = next_ | np.concatenate([[False], next_[:-1]]) if len(maybe) else maybe
        begin, end = begin[maybe], end[maybe]
        if len(begin):
            b, d = seeds(code, begin, end, size)
            first = np.flatnonzero(~_follows(b, d, size))
            blocks = np.diff(np.append(first, len(b)))
            first = first[blocks > 1]
            low, high, d = b[first], b[first] + blocks[blocks > 1] * size, d[first]
            known = covered[low] >= high + d
            low, high, d = low[~known], high[~known], d[~known]
            row = text.row[low]
            low = low - _reach(code, low, d, offsets[row], -1)
            high = high + _reach(code, high, d, offsets[row + 1] - d, 1) + d
            long_ = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
            made = np.unique(np.stack([row, low, high, d], 1)[long_], axis=0)
            found.append(made)
            for _, x, y, _ in made:
                np.maximum(covered[x:y], y, out=covered[x:y])
        size *= 2
    all_ = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    all_ = all_[np.lexsort((all_[:, 3], all_[:, 1], all_[:, 0]))]
    new = np.ones(len(all_), bool)  # of one stretch only the smallest period counts
    seen: dict[tuple[int, int], int] = {}
    for k, (_, x, y, d) in enumerate(all_):
        new[k] = seen.setdefault((int(x), int(y)), int(d)) == d
    all_ = all_[new]
    return all_[:, 0], all_[:, 1] - offsets[all_[:, 0]], all_[:, 2] - all_[:, 1], all_[:, 3]


def collapsed(text: Text, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The texts without what repeats the first period of a run, words joined by one space."""
    change = np.zeros(len(text.code) + 1, np.int64)
    begin = text.offsets[row] + start
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[text.offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), text.words.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.string())


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed_text), one row for each row of docs.

    Words are what stands between the six white-space characters, told apart in every
    byte, and numbered from 0. runs: all (start, length, period), by start and period, of stretches with
    that smallest period, of at least max(LEAST_WORDS, LEAST_PERIODS * period) words, which no
    neighbouring word extends. collapsed_text: the words that no run holds after its first period, joined by
    one space. Null, empty and blank texts have no words, no runs and an empty text. Rows
    are worked on each by itself, so repeated rows and ids change nothing; other columns are not read,
    whatever their names. An empty table gives an empty result.

    Nothing is shuffled. Texts are worked on SLICE bytes at a time; a longer one alone takes about 100 bytes a word.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = T.StructType([
        T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed_text", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + SLICE, "right")) - 1)
                part = batch.slice(low, high - low)
                text = Text(part.column(1))
                row, *told = runs(text)
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                each = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in told], names=RUN.names))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(text.offsets)), each, collapsed(text, row, *told)], names=out.names)
                low = high

    return rows.mapInArrow(run, out)
