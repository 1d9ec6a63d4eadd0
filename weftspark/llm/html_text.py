"""Main text of web pages: marked containers, and differencing against the page with the nearest URL.

Each page is cut into blocks of text. What an article or main element holds is the
article, without the parts that are marked as something else (navigation, forms,
advertising, comments ...). Where a page marks no article, its blocks are aligned by
longest common subsequence with those of the page of the same host whose path is
nearest, and the blocks both have - the site's frame - are deleted. Differencing alone
loses article lines that two pages share and keeps frame lines that differ from page to
page, so it decides marked pages only if asked to.
"""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.common import settle

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: Elements whose content is no markup.
_RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in "script style textarea noscript template svg iframe title".split()}
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_ARTICLE = {"article", "main"}
_OTHER = set("nav footer aside form button select option dialog menu head object embed canvas audio video map fieldset".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words in class, id and role that mark something other than the article.
_MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices newsletter subscribe subscription signup login sidebar side menu menus nav navbar navigation breadcrumb "
    "breadcrumbs comment comments disqus respond replies related recommended share sharing social popup modal overlay "
    "footer masthead header search pagination pager toolbar widget widgets contentinfo complementary alert alertdialog".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
#: Elements of running text: their class says nothing about the page's parts, only that of what holds them does.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}


class _TagEnds:
    """Where tags end: the first > outside quotes. Each page is looked through once, however its quotes and brackets are nested."""

    def __init__(self, page: str):
        self.at = [m.start() for m in re.finditer("[>\"']", page)]
        self.end: list[int] = [-1] * (len(self.at) + 1)
        later = {'"': len(self.at), "'": len(self.at)}  # the next quote of each kind
        for k in range(len(self.at) - 1, -1, -1):
            what = page[self.at[k]]
            if what == ">":
                self.end[k] = self.at[k]
            else:
                self.end[k] = self.end[later[what] + 1] if later[what] < len(self.at) else -1
                later[what] = k

    def __call__(self, begin: int) -> int:
        """The place of the > that ends a tag whose name ends at `begin`; -1 if none does."""
        return self.end[bisect_left(self.at, begin)]


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it closes, attributes) of the tags of a page; comments, declarations and elements without markup have no name.

    What is never closed is text, but for comments and such elements, which reach to the end.
    """
    ends, at, size = None, 0, len(page)
    last_data, last_end = page.rfind("]]>"), page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or (at > last_end and not page.startswith("<!--", at)):
            if at >= 0:
                at = page.find("<!--", at)
            if at < 0:
                return
        m = _OPEN.match(page, at)
        if not m:
            at += 1
            continue
        begin, name = at, (m[5] or "").lower()
        if m[1]:
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            yield begin, at, "", False, ""
        elif m[2] and last_data >= m.end():
            at = page.find("]]>", m.end()) + 3
            yield begin, at, "", False, ""
        elif m[2] or m[3]:
            at = page.find(">", at) + 1
            yield begin, at, "", False, ""
        else:
            ends = ends or _TagEnds(page)
            end = ends(m.end())
            if end < 0:
                at += 1
            elif name in _RAW and not m[4]:
                close = _RAW[name].search(page, end + 1)
                at = close.end() if close else size
                yield begin, at, "", False, ""
            else:
                at = end + 1
                yield begin, at, name, bool(m[4]), page[m.end() : end]


def _other(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is something other than the article; a header inside an article is part of it."""
    if name in _OTHER or (name == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if _HIDDEN.search(found.get("style", "")) or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return True
    if name in ("body", "html", *_ARTICLE):
        return name == "article" and bool({"comment", "comments", "related", "promo"} & set(_WORD.findall(found.get("class", "").lower())))
    if found.get("role", "").lower() == "main":
        return False
    if name in _PROSE:
        return False
    words = set(_WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
    if name == "header":
        words -= {"header"}
    return bool(words & _MARKS)


def blocks(page: str | None) -> tuple[list[str], list[str]]:
    """(blocks of the article, blocks outside any that nothing marks as something else), in page order.

    Character references are decoded after markup is cut, white space becomes one
    space, empty blocks go. Unclosed elements end with the element that holds them.
    """
    article: list[str] = []
    outside: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside an article, inside something else
    text: list[str] = []
    page = page or ""

    def close() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                (article if stack and stack[-1][1] else outside).append(block)

    at = 0
    open_: Counter[str] = Counter()
    for begin, end, name, closes, attributes in tokens(page):
        if begin > at and not (stack and stack[-1][2]):
            text.append(page[at:begin])
        at = end
        if not name:
            continue
        if name in _INLINE and not (attributes and not closes and name not in _VOID and _other(name, attributes, True)):
            if name == "br":
                text.append(" ")
            if closes and stack and stack[-1][0] == name and name not in _VOID:
                close()
                stack.pop()
                open_[name] -= 1
            continue
        if closes:
            if open_[name]:
                close()
                gone = ""
                while gone != name:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
            elif name not in _INLINE:
                close()
            continue
        close()
        if name in _VOID or attributes.rstrip().endswith("/") and name not in ("p", "div"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            open_[stack.pop()[0]] -= 1  # these end where the next one begins
        inside, other = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        inside = inside or name in _ARTICLE or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))
        open_[name] += 1
        stack.append((name, inside, other or _other(name, attributes, inside)))
    if not (stack and stack[-1][2]):
        text.append(page[at:])
    close()
    return article, outside


#: Cells of a table of common subsequences that are held at once, one bit each.
CELLS = 1 << 27


def unshared(own: list[str], other: list[str]) -> list[str]:
    """The lines of own outside a longest common subsequence with other.

    Lines that stand on one side alone go first. Rows of the table of common lengths are
    kept as bits of one number each (Crochemore and others' method), so repeated lines
    cost no more than others; beyond CELLS the table is halved by Hirschberg's method.
    """
    both = {*own} & {*other}
    keep = [i for i, line in enumerate(own) if line in both]
    shared = {keep[i] for i in _common([own[i] for i in keep], [line for line in other if line in both])}
    return [line for i, line in enumerate(own) if i not in shared]


def _rows(own: list[str], other: list[str]) -> Iterator[int]:
    """For each line of own a number whose bit j is 0 where the common length with other grows from j lines to j + 1."""
    at: dict[str, bytearray] = {}
    for j, line in enumerate(other):
        at.setdefault(line, bytearray(len(other) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    masks = {line: int.from_bytes(bits, "little") for line, bits in at.items()}
    every = (1 << len(other)) - 1
    row = every
    for line in own:
        hit = row & masks.get(line, 0)
        row = (row + hit | row - hit) & every
        yield row


def _common(own: list[str], other: list[str]) -> list[int]:
    """Places in own of a longest common subsequence with other."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    found: list[int] = []
    if a and b and len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        for row in _rows(a[:half], b):
            pass
        for back in _rows(a[:half - 1 : -1], b[::-1]):
            pass
        lengths = lambda r: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(r.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little").astype(np.int64))])
        cut = int((lengths(row) + lengths(back)[::-1]).argmax())
        found = _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    elif a and b:
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append(i)
        found.reverse()
    return [*range(head), *(head + i for i in found), *range(len(own) - tail, len(own))]


def _neighbours(keys: DataFrame) -> DataFrame:
    """(id, near): the page of the same host whose path shares the longest beginning; ties to the one before.

    Paths are sorted over the whole cluster by range, so a host with very many pages
    is dealt to many tasks; the first and last row of each range meet in a second,
    small step, one pair of rows for each range.
    """
    ranged = keys.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id")
    ranged = ranged.withColumn("part", F.spark_partition_id())
    local = Window.partitionBy("part").orderBy("host", "path", "id")
    both = lambda c: [F.lag(c).over(local).alias(f"{c}_before"), F.lead(c).over(local).alias(f"{c}_after")]
    rows = settle(ranged.select("*", *both("host"), *both("path"), *both("id"), F.row_number().over(local).alias("n")))
    edge = Window.orderBy("part")
    first = rows.where("n = 1").select("part", *[F.col(c).alias(f"{c}_first") for c in ("host", "path", "id")])
    last = rows.where("id_after is null").select("part", *[F.col(c).alias(f"{c}_last") for c in ("host", "path", "id")])
    borders = first.join(last, "part").select(
        "part",
        *[F.lag(f"{c}_last").over(edge).alias(f"{c}_b") for c in ("host", "path", "id")],
        *[F.lead(f"{c}_first").over(edge).alias(f"{c}_a") for c in ("host", "path", "id")],
    )
    rows = rows.join(borders, "part", "left")
    side = lambda s: {c: F.coalesce(f"{c}_{'before' if s == 'b' else 'after'}", f"{c}_{s}") for c in ("host", "path", "id")}
    before, after = side("b"), side("a")

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else len(os.path.commonprefix([x, y])) for x, y in zip(a, b, strict=True)], dtype="int32")

    same = lambda s: F.when(s["host"] == F.col("host"), s["path"])
    rows = rows.withColumn("cb", common(F.col("path"), same(before))).withColumn("ca", common(F.col("path"), same(after)))
    near = F.when((F.col("cb") >= 0) & (F.col("cb") >= F.col("ca")), before["id"]).when(F.col("ca") >= 0, after["id"])
    return rows.select("id", near.alias("near")).where("near is not null")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trust_markup: bool = True
) -> DataFrame:
    """(id_col, url_col, text), one row for each row of pages.

    text joins the blocks of the main text by \\n; it is empty for null or empty
    pages and where nothing is left. Pages with a null URL have a host of their own.
    Rows that repeat an id are each extracted. Pages of a host with the same blocks are
    copies: they count as one page at the first of their paths, so that none is its own
    neighbour. Other columns are not read. An empty table gives an empty result. Very
    long pages are whole; a page is one value, so one task holds it.

    trust_markup: False lets differencing decide on every page, marked articles too.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    out = T.StructType(
        [
            rows.schema["_id"],
            rows.schema["_url"],
            T.StructField("text", T.StringType()),
            T.StructField("open", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [blocks(x) if trust_markup else ([], every_block(x)) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(["\n".join(a) if a else None for a, _ in found], pa.string()),
                        pa.array([None if a else o for a, o in found], pa.list_(pa.string())),
                    ],
                    names=out.names,
                )

    parsed = settle(rows.mapInArrow(run, out))
    marked = parsed.where("text is not null").select("_id", "_url", "text")
    rest = parsed.where("text is null")
    no_scheme = F.regexp_replace(F.coalesce("_url", F.concat(F.lit("//\x00"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(no_scheme, r"^//([^/?#]*)", 1))
    path = F.regexp_replace(no_scheme, r"^//[^/?#]*", "")
    digest = F.sha2(F.array_join("open", "\n"), 256)
    rest = rest.select("_id", "_url", "open", F.sha2(F.concat_ws("\n", host, digest), 256).alias("copy"), host.alias("host"), path.alias("path"))
    keys = rest.groupBy(F.col("copy").alias("id"), "host").agg(F.min("path").alias("path"))
    near = _neighbours(keys).withColumnRenamed("id", "copy")
    other = rest.groupBy(F.col("copy").alias("near")).agg(F.first("open").alias("other"))
    paired = rest.join(near, "copy", "left").join(other, "near", "left")

    @F.pandas_udf("string")
    def difference(own: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(unshared(list(a), [] if b is None else list(b))) for a, b in zip(own, other, strict=True)])

    framed = paired.select("_id", "_url", difference("open", "other").alias("text"))
    return marked.union(framed).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")


def every_block(page: str | None) -> list[str]:
    """All blocks of text of a page, whatever marks them."""
    lines: list[str] = []
    text: list[str] = []
    page, at = page or "", 0

    def close() -> None:
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            lines.append(block)

    for m in _TOKEN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name == "br":
            text.append(" ")
        elif name and name not in _INLINE:
            close()
    text.append(page[at:])
    close()
    return lines
