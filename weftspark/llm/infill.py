"""Fill-in-middle documents, cut and put together by a pipeline of Arrow compute functions.

Each batch of texts becomes list arrays of units; these are flattened beside the number
of the row that each comes from, ordinals tell where in its row a unit stands, and the
ordinals against a row's two cuts give its role. The units of a role are filtered out,
made lists again and joined; the pieces are joined with the marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.textnum import string_buffers

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text that are cut into units at once; the arrays beside them take about 60 times as much.
SLICE = 1 << 20


def _code_points(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def _lines(raw: np.ndarray) -> np.ndarray:
    first = np.zeros(len(raw), bool)
    first[1:] = raw[:-1] == 0x0A
    return first


#: For each kind of unit the function that says of the bytes of texts where a unit begins; the first byte of a row always does.
UNITS = {"code_point": _code_points, "line": _lines}


class Cut:
    """Where the units of some rows begin: `starts` in `raw`, those of row i at offsets[i]:offsets[i + 1]."""

    def __init__(self, texts: pa.Array, unit: str):
        self.raw, self.at = string_buffers(texts)
        first = UNITS[unit](self.raw)
        first[self.at[:-1][np.diff(self.at) > 0]] = True
        self.starts = np.flatnonzero(first)
        self.offsets = np.searchsorted(self.starts, self.at)

    def lists(self, a: int, b: int) -> pa.LargeListArray:
        """The units a to b of the one long row as one list."""
        return self._lists(np.array([0, b - a]), a, b)

    def all_lists(self) -> pa.LargeListArray:
        return self._lists(self.offsets, 0, len(self.starts))

    def _lists(self, offsets: np.ndarray, a: int, b: int) -> pa.LargeListArray:
        edges = np.append(self.starts, len(self.raw))[a : b + 1].astype(np.int64)
        low, high = (int(edges[0]), int(edges[-1])) if len(edges) else (0, 0)
        units = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(edges - low), pa.py_buffer(np.ascontiguousarray(self.raw[low:high])))
        return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units)


def pieces(lists: pa.LargeListArray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """The first low[i] units of each row i, those up to high[i] and the rest, joined."""
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    size = pc.list_value_length(lists).to_numpy()
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(lists.offsets, parent))
    before, within = (pc.less(ordinal, pc.take(pa.array(cut), parent)) for cut in (low, high))
    out = []
    for role, count in ((before, low), (pc.and_not(within, before), high - low), (pc.invert(within), size - high)):
        offsets = np.concatenate([[0], np.cumsum(count)])
        out.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units.filter(role)), pa.scalar("", pa.large_string())))
    return out


def long_pieces(cut: Cut, low: int, high: int) -> list[pa.Array]:
    """`pieces` of one long row, some units at a time."""
    parts: list[list] = [[], [], []]
    a, n = 0, len(cut.starts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(cut.starts, cut.starts[a] + SLICE)))
        for own, piece in zip(parts, pieces(cut.lists(a, b), np.array([min(max(low - a, 0), b - a)]), np.array([min(max(high - a, 0), b - a)])), strict=True):
            own.append(piece[0].as_py())
        a = b
    return [pa.array(["".join(own)], pa.large_string()) for own in parts]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows whose sizes add up to at most `most`; a larger row stands alone."""
    total, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        yield low, high
        low = high


def transformed(texts: pa.Array, draws: list[np.ndarray], unit: str, plain_rate: int, spm_rate: int, marks: tuple[str, str, str]) -> list[pa.Array]:
    """(units, form, units of the prefix, units of the middle, output) of some rows; draws: four random numbers for each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    cut = Cut(texts, unit)
    n = np.diff(cut.offsets)
    ends = [draws[k].astype(np.int64) % (n + 1) for k in (0, 1)]
    low, high = np.minimum(*ends), np.maximum(*ends)
    plain = pc.equal(texts, "")
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    plain = plain.to_numpy(zero_copy_only=False) | (draws[2] % 100 >= 100 - plain_rate)
    spm = draws[3] % 100 < spm_rate
    chosen = np.flatnonzero(~plain)
    output = texts
    if len(chosen):
        if len(texts) == 1:
            prefix, middle, suffix = long_pieces(cut, int(low[0]), int(high[0]))
        else:
            lists = cut.all_lists().take(pa.array(chosen))
            prefix, middle, suffix = pieces(lists, low[chosen], high[chosen])
        p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (*marks, ""))
        made = pc.if_else(
            pa.array(spm[chosen]), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
        )
        output = pc.replace_with_mask(texts, pa.array(~plain), made)
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    null = pa.array(plain)
    none = pa.scalar(None, pa.int64())
    return [pa.array(n), pa.array(form.tolist(), pa.string()), pc.if_else(null, none, pa.array(low)), pc.if_else(null, none, pa.array(high - low)), output.cast(pa.string())]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "code_point",
    seed: str = "1",
    plain_rate: int = 10,
    spm_rate: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(id_col, n, form, prefix_units, middle_units, output), one row for each row of docs.

    A text of n units is cut in three: the prefix ends at the smaller of two places drawn
    from 0 to n, the middle at the larger. `psm` documents give prefix, suffix and middle,
    `spm` ones suffix, prefix and middle, each after its mark. plain_rate of 100 texts stay
    as they are, as do empty texts and those that hold a mark; of the others spm_rate of 100
    are `spm`. Draws are the first four groups of eight hexadecimal digits of
    sha256(seed:id), so reruns agree; a null id draws as an empty one, rows that repeat
    an id alike. Null texts are empty. Plain texts have no units of prefix and middle (null).
    Other columns are not read, whatever their names; an empty table gives an empty result.

    Nothing is shuffled, and texts are worked on SLICE bytes at a time, long ones too.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    if len(set(marks)) != 3 or not all(marks) or any(b.startswith(a[k:]) for a in marks for b in marks for k in range(1, len(a))) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must differ, and none may hold another or end as one begins: outputs could not be read back")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), digest.alias("_digest")).select(
        "_id", "_text", *[F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    )
    out = T.StructType([
        T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for a, b in slices(sizes, SLICE):
                part = batch.slice(a, b - a)
                draws = [part.column(2 + k).to_numpy() for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *transformed(part.column(1), draws, unit, plain_rate, spm_rate, marks)], names=out.names)

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle was made of."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    at = lambda *order: F.concat(*[F.get(part, k) for k in order])
    return F.when(form == PSM, at(1, 3, 2)).when(form == SPM, at(2, 3, 1)).otherwise(output)


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cuts AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS e1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS e2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, substring(t, 1, least(e1, e2)) AS p, substring(t, least(e1, e2) + 1, greatest(e1, e2) - least(e1, e2)) AS m, substring(t, greatest(e1, e2) + 1) AS s
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(e1, e2) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(e1, e2) - least(e1, e2) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
