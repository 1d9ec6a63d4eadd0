"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes, counted over its
training texts and then frozen. A symbol's code length is that of the longest
context in the tree that has seen it: a context with n symbols seen, u of them
distinct, gives a seen symbol c / (n + u) and escapes with u / (n + u) to the next
shorter one; below the empty context every byte has 1/256. A text's language is the
one whose tree gives the shortest code. All 256 bytes are symbols of their own, but
that A-Z count as a-z and white space as a space; a tree holds the contexts it has seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.common import settle
from weftspark.llm.textnum import string_buffers

ORDER = 3
#: Bound on the sample that the trees are counted on: texts of each language, by smallest digest of id and text.
SAMPLE = 600
#: Digests that are ranked of each language: about ROOM times the sample and SPARE more, so that fewer than the sample is out of the question.
ROOM, SPARE = 1.5, 50
NONE = "und"
#: What Arrow batches are cut to before the per-byte arrays are made.
_SLICE = 1 << 21


def _folded(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z and white space as a space: case and layout tell nothing about the language."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[9:14] = 32
    return fold[raw]


class Trees:
    """Code lengths in bits of a byte after the ORDER bytes before it, for each language.

    A number stands for some bytes, the last one lowest. For each order: `codes`, the
    sorted contexts with a byte that any language has seen there, with their `bits` in
    every language; and `contexts`, with the bits of the `escape` from them.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language the numbers of ORDER + 1 bytes and how often they occur."""
        self.languages = languages
        self.codes, self.bits, self.contexts, self.escape = [], [], [], []
        for order in range(ORDER + 1):
            trees = []
            for code, n in counts:
                short, which = np.unique(code & np.uint32(256 ** (order + 1) - 1), return_inverse=True)
                trees.append((short, np.bincount(which, n, len(short))))
            codes = np.unique(np.concatenate([code for code, _ in trees]))
            contexts, of = np.unique(codes >> np.uint32(8), return_inverse=True)
            escape = np.zeros((len(contexts), len(languages)), np.float32)
            bits = self._shorter(codes, order)
            for k, (code, n) in enumerate(trees):
                at = np.searchsorted(codes, code)
                total, distinct = np.bincount(of[at], n, len(contexts)), np.bincount(of[at], minlength=len(contexts))
                known = total > 0
                escape[known, k] = np.log2((total + distinct)[known] / distinct[known])
                bits[:, k] += escape[of, k]
                bits[at, k] = np.log2((total + distinct)[of[at]] / n)
            for had, new in ((self.codes, codes), (self.bits, bits), (self.contexts, contexts), (self.escape, escape)):
                had.append(new)
        self._hash()

    def _shorter(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of codes of `order` that have escaped from there."""
        if not order:
            return np.full((len(codes), len(self.languages)), 8, np.float32)
        return self._search(codes & np.uint32(256**order - 1), order - 1)

    def _search(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of any codes from `order` downwards."""
        out = np.empty((len(codes), len(self.languages)), np.float32)
        seen, at = _find(self.codes[order], codes)
        out[seen] = self.bits[order][at]
        rest = np.flatnonzero(~seen)
        if len(rest):
            bits = self._shorter(codes[rest], order)
            known, at = _find(self.contexts[order], codes[rest] >> np.uint32(8))
            bits[known] += self.escape[order][at]
            out[rest] = bits
        return out

    def _hash(self) -> None:
        """A table of the longest codes by hash, those of equal hash in the next free places."""
        keys = self.codes[ORDER]
        self.shift = 32 - max(4, (2 * len(keys)).bit_length())
        self.table = np.full(1 << (32 - self.shift), -1, np.int32)
        place, open_ = self._place(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.table[place[open_]] < 0]
            self.table[place[free]] = free
            open_ = open_[self.table[place[open_]] != open_]
            place[open_] = (place[open_] + 1) % len(self.table)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> np.uint32(self.shift)).astype(np.int64)

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each of codes in each language."""
        keys = self.codes[ORDER]
        place = self._place(codes)
        slot = self.table[place]
        open_ = np.flatnonzero(slot >= 0)
        open_ = open_[keys[slot[open_]] != codes[open_]]
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.table)
            slot[open_] = self.table[place[open_]]
            open_ = open_[slot[open_] >= 0]
            open_ = open_[keys[slot[open_]] != codes[open_]]
        missed = np.flatnonzero(slot < 0)
        if not len(missed):
            return self.bits[ORDER][slot]
        new, which = np.unique(codes[missed], return_inverse=True)
        out = np.empty((len(codes), len(self.languages)), np.float32)
        had = np.flatnonzero(slot >= 0)
        out[had] = self.bits[ORDER][slot[had]]
        out[missed] = self._search(new, ORDER)[which]
        return out

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each row raw[at[i]:at[i + 1]] under each language, every byte counted."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _SLICE, "right")) - 1)
            for begin in range(at[low], at[high], _SLICE * 2):  # a long text in pieces
                end = min(at[high], begin + _SLICE * 2)
                codes = context_codes(_folded(raw[max(at[low], begin - ORDER) : end]), at[low : high + 1] - max(at[low], begin - ORDER), ORDER)
                codes = codes[begin - max(at[low], begin - ORDER) :]
                total = np.zeros((len(codes) + 1, len(self.languages)))
                np.cumsum(self.code_lengths(codes), axis=0, out=total[1:])
                edge = np.clip(at[low : high + 1] - begin, 0, len(codes))
                out[low:high] += total[edge[1:]] - total[edge[:-1]]
            low = high
        return out


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of asked is among the sorted keys, where those are that are)."""
    at = np.searchsorted(keys, asked)
    seen = at < len(keys)
    seen[seen] = keys[at[seen]] == asked[seen]
    return seen, at[seen]


def context_codes(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the `order` before it as one number; a row begins as if after spaces."""
    code = symbols.astype(np.uint32)
    starts = at[:-1][(at[:-1] >= 0) & (at[:-1] < len(symbols))]
    for k in range(1, order + 1):
        before = np.full(len(symbols), 32, np.uint32)
        before[k:] = symbols[:-k]
        for j in range(k):
            inside = starts[starts + j < len(symbols)] + j
            before[inside] = 32
        code |= before << np.uint32(8 * k)
    return code


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> tuple:
    """(languages, for each the numbers of ORDER + 1 bytes and how often they occur) from at most `sample` whole texts of each.

    Null languages and texts teach nothing, empty texts have no byte to count; rows that repeat an id and text
    count once. Counting runs where the texts are; the driver gets the counts, no more of
    them than the sample has bytes. An empty table gives no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)).alias("h")
    )
    digests = settle(rows.select("lang", "h").distinct())
    # distinct digests are spread evenly over their range: those below that share of it are ROOM * sample + SPARE, give or take a few dozen, or all there are
    most = F.lit((ROOM * sample + SPARE) * 2.0**64) / F.col("count") - 2.0**63
    sizes = F.broadcast(digests.groupBy("lang").count().select("lang", most.alias("most")))  # one row a language
    low = digests.join(sizes, "lang").where(F.col("h").cast("double") <= F.col("most")).select("lang", "h")
    chosen = (
        low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .where(F.col("r") <= sample)
        .groupBy("lang")
        .agg(F.max("h").alias("last"))
    )
    chosen = settle(chosen)
    languages = sorted(r["lang"] for r in chosen.collect())
    if not languages:
        return [], []
    texts = rows.join(F.broadcast(chosen), "lang").where("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("lang", "code", "n")])

    def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([languages.index(k) for k in batch.column(0).to_pylist()])
            raw, at = string_buffers(batch.column(1))
            codes, of = context_codes(_folded(raw), at, ORDER), np.repeat(names, np.diff(at))
            for i in np.unique(names):
                code, n = np.unique(codes[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i)), pa.array(code.astype(np.int64)), pa.array(n)], names=schema.names)

    found = texts.mapInArrow(count_contexts, schema).groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "code"])
    own = [found[found.lang == i] for i in range(len(languages))]
    return languages, [(part.code.to_numpy().astype(np.uint32), part.n.to_numpy()) for part in own]


#: The trees of the model that this Python worker used last.
_BUILT: dict[str, Trees] = {}


def _trees(languages: list[str], counts: list, name: str) -> Trees:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Trees(languages, counts)
    return _BUILT[name]


def predict(docs: DataFrame, model: tuple, text_col: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and lang_pred, score, bits.

    lang_pred: the language with the shortest code, ties to the first by name; `und`
    (score 0) for texts that are null or have no letter, and when nothing was learned.
    score: the winner's share of 2 ** -(bits a symbol) over all languages.
    """
    languages, counts = model
    digest = hashlib.sha256(repr(languages).encode())
    for code, n in counts:
        digest.update(code.tobytes() + n.tobytes())
    name = digest.hexdigest()
    out = T.StructType(
        [*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    )
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for batch in batches:
            trees = trees or (_trees(languages, counts, name) if languages else None)
            raw, at = string_buffers(batch.column(len(keep)))
            letter = np.array(batch.column(len(keep) + 1).to_pylist(), bool)
            if trees is None:
                best, share, bits = np.zeros(len(letter), int), np.zeros(len(letter)), np.zeros(len(letter))
                letter = letter & False
            else:
                total = trees.score(raw, at)
                best = total.argmin(1)
                bits = total.min(1)
                mean = total / np.maximum(1, np.diff(at))[:, None]
                share = 1 / np.exp2(mean.min(1, keepdims=True) - mean).sum(1)
            names = [languages[b] if ok else NONE for b, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(bits)],
                names=out.names,
            )

    return rows.mapInArrow(run, out)
