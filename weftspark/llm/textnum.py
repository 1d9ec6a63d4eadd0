"""Words and shingles of Arrow string columns as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[_FOLD] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are hashed at once: the working arrays take about 40 times as much.
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of each row, lower-cased in A-Z.

    hashes: one 64-bit hash a word; start, end: its bytes in the row's text;
    offsets: row i has the words offsets[i]:offsets[i + 1].
    """

    def __init__(self, texts: pa.Array, between: np.ndarray | Callable = _SPACE, split: Callable | None = None):
        """between: for each byte whether it stands between words, or a function of the bytes that says so for each
        of them; by default the six white-space characters. split: a function of the bytes and of where the words begin
        and end, which gives both, in order, for the pieces to take in their place."""
        raw, at = string_buffers(texts)
        self.raw, self.at = raw, at
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        space = between(raw) if callable(between) else between[raw]
        first = ~space
        first[1:] &= space[:-1]
        first[edges] = ~space[edges]
        last = ~space
        last[:-1] &= space[1:]
        last[edges - 1] = ~space[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if split is not None:
            s, e = split(raw, s, e)
        self.hashes = np.empty(len(s), np.uint64)
        power = np.cumprod(np.full(_BLOCK + 1, _BASE, np.uint64))
        back = np.cumprod(np.full(_BLOCK + 1, _BACK, np.uint64))
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + _BLOCK, "right")))
            low, high = int(s[i]), int(e[j - 1])
            if high - low > _BLOCK:  # one word longer than a block
                power = np.cumprod(np.full(high - low + 1, _BASE, np.uint64))
                back = np.cumprod(np.full(high - low + 1, _BACK, np.uint64))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[raw[low:high]] * power[: high - low], out=sums[1:])
            self.hashes[i:j] = (sums[e[i:j] - low] - sums[s[i:j] - low]) * back[s[i:j] - low]
            i = j
        self.hashes = mix(self.hashes + (e - s).astype(np.uint64))
        self.offsets = np.searchsorted(s, at)
        row = np.repeat(np.arange(len(at) - 1), np.diff(self.offsets))
        self.start, self.end = s - at[row], e - at[row]
        self.row = row

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words, and the word each begins with; none crosses rows."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(count, np.uint64)
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + count]
        within = np.flatnonzero(self.row[:count] == self.row[n - 1 :])
        return mix(total[within]), within


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Each row's distinct n-word shingles as sorted hashes; fewer words make one shingle, none an empty set."""
    words = Words(texts)
    grams, first = words.grams(n)
    edges = np.searchsorted(first, words.offsets)
    out = []
    for i in range(len(words.offsets) - 1):
        a, b = words.offsets[i], words.offsets[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[edges[i] : edges[i + 1]]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in words.hashes[a:b]:
                    whole = whole * np.uint64(0xA0761D6478BD642F) + h
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
