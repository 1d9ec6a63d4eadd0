"""Toxicity scores from a bidirectional gated recurrent network, written in numpy.

Words end at ASCII characters other than letters and digits and at Unicode spaces and
punctuation. A run of more than LONGEST bytes is read as overlapping pieces, each a word.
A word enters as two vectors: that of the word, if the training texts had it often
enough, and the mean of its characters' vectors by position. One network reads a
window of WINDOW words forwards, one backwards; attention pools their states, and
a linear layer gives the window's logit. Windows begin every STRIDE words, so that
they overlap and cover the whole text. A text scores as its highest window does,
through a logistic curve that is fitted on the training texts.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.common import settle
from weftspark.llm.textnum import Words

WINDOW, STRIDE = 32, 16
DIM_WORD, DIM_CHAR, HIDDEN, ATTEND = 8, 8, 8, 8
PLACES = 12
#: Bytes of the longest word that is read whole; the pieces of a longer one begin every STEP bytes and have PIECE, whole characters each.
LONGEST, PIECE, STEP = 64, 12, 6
#: Bounds on the training sample: documents of each label by smallest digest, and their characters; texts are read whole or not at all.
SAMPLE, CHARS = 1500, 6 << 20
EPOCHS = 12
#: Windows that a network takes at once.
AT_ONCE = 2048
#: Characters that are scored at once.
HELD = 1 << 20
#: A word needs so many training texts for a vector of its own, and one of so many of all of them.
OFTEN, OFTEN_SHARE = 5, 150
#: One text of so many of the sample is not trained on: the logistic curve is fitted on these.
CURVE = 4

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32
#: For each code point whether it stands between words: spaces and punctuation.
_APART = np.array([unicodedata.category(chr(c))[0] in "ZP" for c in range(0x110000)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def between(raw: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether it belongs to a character between words."""
    out = _BETWEEN[raw]
    for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF5)):
        at = np.flatnonzero((raw >= low) & (raw < high))
        code = raw[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            code = code << 6 | raw[at + k] & 0x3F
        at = at[_APART[code]]
        for k in range(size):
            out[at + k] = True
    return out


def pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, those of more than LONGEST bytes in overlapping pieces that leave no byte out."""
    size = end - start
    if not (size > LONGEST).any():
        return start, end
    count = np.where(size > LONGEST, -(-(size - PIECE) // STEP) + 1, 1)
    word = np.repeat(np.arange(len(start)), count)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[word] + turn * STEP
    stop = np.where(size[word] > LONGEST, np.minimum(begin + PIECE, end[word]), end[word])
    for _ in range(3):  # to the edges of characters
        begin = begin - ((raw[begin] & 0xC0 == 0x80) & (begin > start[word]))
        stop = stop + ((stop < end[word]) & (raw[np.minimum(stop, len(raw) - 1)] & 0xC0 == 0x80))
    return begin, stop


def _words(texts: pa.Array) -> Words:
    return Words(texts, between, pieces)


class Network:
    """Parameters p, and the sorted hashes of the words with vectors of their own."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        dim = DIM_WORD + DIM_CHAR
        self.vocabulary = vocabulary
        self.p = {
            "word": normal(len(vocabulary) + 1, DIM_WORD, scale=0.05),
            "char": normal(256 * PLACES, DIM_CHAR, scale=0.3),
            "in": normal(2, dim, 3 * HIDDEN, scale=0.3),
            "bias": np.zeros((2, 3 * HIDDEN), np.float32),
            "state": normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "attend": normal(2 * HIDDEN, ATTEND, scale=0.3),
            "query": normal(ATTEND, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "level": np.zeros(1, np.float32),
        }
        self.p["word"][:-1, 0] = odds  # training starts from how much likelier a word is in toxic texts
        self.curve = (1.0, 0.0)

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(vectors of the distinct words, which of them each word is, what backward() needs)."""
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        row = words.row[first]
        begin, end = words.at[row] + words.start[first], words.at[row] + words.end[first]
        size = end - begin
        mean, chars = np.zeros((len(distinct), DIM_CHAR), self.p["char"].dtype), []
        for a in range(0, len(distinct), 1 << 16):
            part = size[a : a + (1 << 16)]
            edges = np.concatenate([[0], np.cumsum(part)[:-1]])
            place = np.arange(part.sum()) - np.repeat(edges, part)
            own = _FOLD[words.raw[np.repeat(begin[a : a + (1 << 16)], part) + place]] + 256 * np.minimum(place, PLACES - 1)
            mean[a : a + (1 << 16)] = np.add.reduceat(self.p["char"][own], edges, axis=0) / part[:, None]
            chars.append(own.astype(np.int16))
        chars = np.concatenate(chars)
        slot = np.searchsorted(self.vocabulary, distinct)
        known = slot < len(self.vocabulary)
        known[known] = self.vocabulary[slot[known]] == distinct[known]
        slot = np.where(known, slot, len(self.vocabulary))
        x = np.concatenate([self.p["word"][slot], mean.astype(np.float32)], 1)
        return x, which, (slot, chars, size)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows: index (n, WINDOW) points into x, -1 where a window has ended."""
        p, n = self.p, len(index)
        there = (index >= 0).astype(np.float32)
        states = np.zeros((2, WINDOW, n, HIDDEN), np.float32)
        tape = []
        for d in range(2):
            projected = np.concatenate([x @ p["in"][d] + p["bias"][d], np.zeros((1, 3 * HIDDEN), np.float32)])
            h = np.zeros((n, HIDDEN), np.float32)
            u = p["state"][d]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                a, m = projected[index[:, t]], there[:, t : t + 1]
                gates = sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                if keep:
                    tape.append((d, t, h, z, r, c))
                h = h + m * z * (c - h)
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], 2)  # (WINDOW, n, 2 HIDDEN)
        seen = np.tanh(both @ p["attend"])
        weight = seen @ p["query"]
        weight = np.where(there.T > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight = weight * there.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * both).sum(0)
        logit = pooled @ p["out"] + p["level"]
        return (logit, (there, both, seen, weight, pooled, tape)) if keep else logit

    def backward(self, x, index, saved, slope, extra) -> dict[str, np.ndarray]:
        """Gradients of the parameters from the slope of the loss by each logit."""
        p = self.p
        there, both, seen, weight, pooled, tape = saved
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["level"] = pooled.T @ slope, slope.sum(keepdims=True)
        d_pooled = slope[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_seen = d_score[:, :, None] * p["query"] * (1 - seen**2)
        g["query"] = (d_score[:, :, None] * seen).sum((0, 1))
        g["attend"] = np.tensordot(both, d_seen, ([0, 1], [0, 1]))
        d_both = d_both + d_seen @ p["attend"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        d_h = [np.zeros((len(index), HIDDEN), np.float32) for _ in range(2)]
        for d, t, h, z, r, c in reversed(tape):
            u, m = p["state"][d], there[:, t : t + 1]
            step = d_h[d] + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            inner = m * step
            d_c = inner * z * (1 - c**2)
            d_z = inner * (c - h) * z * (1 - z)
            d_rh = d_c @ u[:, 2 * HIDDEN :].T
            d_r = d_rh * h * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], 1)
            g["state"][d][:, : 2 * HIDDEN] += h.T @ d_gate
            g["state"][d][:, 2 * HIDDEN :] += (r * h).T @ d_c
            d_h[d] = step - inner * z + d_rh * r + d_gate @ u[:, : 2 * HIDDEN].T
            d_a = np.concatenate([d_gate, d_c], 1) * m
            g["bias"][d] += d_a.sum(0)
            g["in"][d] += x[index[:, t]].T @ d_a
            np.add.at(d_x, index[:, t], d_a @ p["in"][d].T)
        d_x = d_x[:-1]
        slot, chars, size = extra
        np.add.at(g["word"], slot, d_x[:, :DIM_WORD])
        np.add.at(g["char"], chars, np.repeat(d_x[:, DIM_WORD:] / size[:, None], size, axis=0))
        return g


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of each place of each window, -1 beyond the text; row of each window). Rows without words have none."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (turn * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(place < n[row][:, None], offsets[row][:, None] + place, -1), row


def window_logits(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    words = _words(texts)
    if not len(words.hashes):
        return np.zeros(0, np.float32), np.zeros(0, np.int64), ()
    x, which, _ = net.inputs(words)
    places, row = windows(words.offsets)
    out = np.empty(len(row), np.float32)
    for at in range(0, len(row), AT_ONCE):
        part = places[at : at + AT_ONCE]
        out[at : at + AT_ONCE] = net.forward(x, np.where(part >= 0, which[part], -1))
    return out, row, (words, places)


def text_logits(net: Network, texts: pa.Array) -> np.ndarray:
    """Each text's highest window; texts without words have that of an empty window."""
    logits, row, _ = window_logits(net, texts)
    out = np.full(len(texts), -np.inf)
    np.maximum.at(out, row, logits)
    return np.where(np.isinf(out), net.p["level"][0], out)


def fit(texts: list[str], labels: np.ndarray, share: float | None = None, epochs: int = EPOCHS, seed: int = 1) -> Network | float:
    """A network trained on labelled texts; their share of toxic ones if only one label occurs.

    share: of toxic texts where the sample comes from, for which the curve is fitted.

    A text's label is that of its highest window, so each epoch scores all windows
    and then learns the highest of every text and, of texts that aren't toxic, one
    drawn at random.
    """
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    turn = np.arange(len(labels)) % CURVE == CURVE - 1
    if len({*labels[turn]}) < 2 or len({*labels[~turn]}) < 2:
        turn = np.zeros(len(labels), bool)
    everything, every_label = pa.array(texts, pa.large_string()), labels
    column, labels = everything.filter(pa.array(~turn)), labels[~turn]
    words = _words(column)
    own = [np.unique(words.hashes[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    vocabulary, which, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    toxic = np.bincount(which, np.repeat(labels, [len(o) for o in own]), len(vocabulary))
    mean = labels.mean()
    odds = np.log((toxic + 0.5 * mean) / (df - toxic + 0.5 * (1 - mean))) - np.log(mean / (1 - mean))
    often = df >= max(OFTEN, len(labels) // OFTEN_SHARE)
    net = Network(vocabulary[often], np.clip(odds[often] * np.minimum(1, df[often] / 12), -2, 4).astype(np.float32), seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    places, row = windows(words.offsets)
    edges = np.searchsorted(row, np.arange(len(labels) + 1))
    step = 0
    for _ in range(epochs):
        x, which, _ = net.inputs(words)
        logits = np.concatenate(
            [net.forward(x, np.where(places[a : a + AT_ONCE] >= 0, which[places[a : a + AT_ONCE]], -1)) for a in range(0, len(row), AT_ONCE)]
        )
        chosen = []
        for i in range(len(labels)):
            a, b = edges[i], edges[i + 1]
            if a < b:
                chosen += [a + int(logits[a:b].argmax())]
                if not labels[i]:
                    chosen += list(a + rng.integers(0, b - a, 1))
        chosen = rng.permutation(np.array(chosen))
        size = min(256, max(16, len(chosen) // 25))
        for a in range(0, len(chosen), size):
            part = places[chosen[a : a + size]]
            used, index = np.unique(part[part >= 0], return_inverse=True)
            sub = _Subset(words, used)
            x, own, extra = net.inputs(sub)
            full = np.full(part.shape, -1)
            full[part >= 0] = own[index]
            logit, saved = net.forward(x, full, keep=True)
            y = labels[row[chosen[a : a + size]]]
            slope = ((sigmoid(logit) - y) * 1 / len(y)).astype(np.float32)
            g = net.backward(x, full, saved, slope, extra)
            step += 1
            for k, v in net.p.items():
                d = g[k] + 1e-4 * v
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                rate = {"word": 0.004, "char": 0.002}.get(k, 0.01)
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    if turn.any():
        column, labels = everything.filter(pa.array(turn)), every_label[turn]
    share = labels.mean() if share is None else min(max(share, 1e-4), 1 - 1e-4)
    weight = np.where(labels > 0, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    net.curve = _logistic(text_logits(net, column), labels, weight)
    return net


class _Subset:
    """Some words of Words, as inputs() reads them."""

    def __init__(self, words: Words, used: np.ndarray):
        self.hashes, self.row = words.hashes[used], words.row[used]
        self.start, self.end, self.at, self.raw = words.start[used], words.end[used], words.at, words.raw


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve of y over x in weighted rows, by Newton's method in bounded steps
    with a small ridge; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * x + b)
        w = weight * p * (1 - p)
        error = weight * (p - y)
        grad = np.array([(error * x).sum() + a - 1, error.sum() + 1e-2 * b])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, float(np.abs(step).max()))
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, seed: int = 1, chars: int = CHARS) -> Network | float:
    """A network from the texts of at most `sample` documents of each label, by smallest digest of the id.

    docs has id_col and text_col, labels id_col and label_col. Ids are drawn before any
    text is read, by each task's smallest digests, and only the drawn documents' texts
    are fetched. Of these, in the same order, as many are learned as have `chars` characters for each label; all their
    windows count, wherever in a text they stand. A text that alone has more is left out.
    The network is fitted in one task of the executors, which holds no more than that sample.

    Labels other than 0 and 1 and null ids or labels teach nothing. An id with several labels counts
    as the highest of them; of several texts of an id the smallest is read. Null and empty texts
    teach nothing, as they have no window. Ties in the digest go by id. An empty table gives the score 0 to every text.
    """
    named = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    there = docs.select(F.col(id_col).alias("id"))
    rows = named.join(there, "id", "left_semi").select("y", "id", F.xxhash64(F.lit(seed), "id").alias("h"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = [rows.where(F.col("y") == y).orderBy("h", "id").limit(sample) for y in (0, 1)]
    # at most 2 * sample rows of three numbers, by limit()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "id")
    texts = settle(texts.groupBy("y", "h", "id").agg(F.min("text").alias("text")))
    sizes = texts.select("y", "h", "id", F.length("text").alias("n")).where(F.col("n") <= chars)
    total = F.sum("n").over(Window.partitionBy("y").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    within = sizes.withColumn("total", total).where(F.col("total") <= chars).select("h", "id")
    texts = texts.join(F.broadcast(within), ["h", "id"])  # at most 2 * sample rows of two numbers

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["text"].fillna("") != ""].sort_values(["h", "id"])
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["y"].to_numpy(), share, seed=seed))]})

    found = texts.groupBy(F.lit(0).alias("all")).applyInPandas(grow, "model binary").first()
    return pickle.loads(found["model"]) if found is not None else 0.0


def score(model: Network | float) -> Column:
    """A pandas function of a text column: the score from 0 to 1. Null and empty texts score as a text without words."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.empty(len(texts))
            size = np.cumsum(texts.str.len().fillna(0).to_numpy())
            at = 0
            while at < len(texts):
                # at most 256 texts and about HELD characters at once, one text at least
                end = max(at + 1, min(at + 256, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right"))))
                part = texts.iloc[at:end]
                if isinstance(model, float):
                    out[at:end] = model
                else:
                    logits = text_logits(model, pa.array(part.tolist(), pa.large_string(), from_pandas=True))
                    out[at:end] = sigmoid(model.curve[0] * logits + model.curve[1])
                at = end
            yield pd.Series(out)

    return run
