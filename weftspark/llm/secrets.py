"""Secrets in texts, told from copied examples by how many owners have them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import settle

#: Kinds in their order, each with its pattern, the group that holds the secret, and its least length.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the ownership count adds: long runs with letters and digits that at most FEW owners and FEW_REPOS repositories have.
ADDED = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
KINDS = (*(k for k, *_ in BASE), ADDED[0])
FEW, FEW_REPOS = 2, 4
#: Matches that are added up at once; a value with one of so many spans of the corpus is frequent, so that there are no more frequent ones.
CHUNK, SHARE = 256, 1000
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's matches, leftmost first and not overlapping: from the lengths of matches and of what lies between.

    Matches are added up in chunks, and chunks start where the sums of those before end,
    so that a text with very many matches costs little more for each.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        fits = F.length(x["v"]) >= least
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(fits, F.array(span)).otherwise(F.array().cast(_SPAN))).alias("out"))

    def of_chunk(chunk: Column, begin: Column) -> Column:
        return F.aggregate(chunk, F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    cut = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / CHUNK).cast("int")), lambda k: F.slice(e, k * CHUNK + 1, F.lit(CHUNK)))
    sums = lambda c: F.transform(c, lambda y: F.aggregate(y, F.lit(0), lambda s, x: s + F.length(x["gap"]) + F.length(x["m"])))
    placed = lambda c: _with(sums(c), lambda n: F.transform(c, lambda y, k: of_chunk(y, add(F.slice(n, F.lit(1), k)))))
    return F.when(text.rlike(pattern), _with(each, lambda e: _with(cut(e), lambda c: F.flatten(placed(c))))).otherwise(F.array().cast(_SPAN))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    sorted_spans = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(
        F.transform(
            sorted_spans,
            lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    few: int = FEW,
    few_repos: int = FEW_REPOS,
) -> DataFrame:
    """(id_col, base, spans), one row for each row of docs.

    base holds the spans of the fixed patterns, spans those and the added ones, as
    structs (start, kind, end, value, repos, owners, live): code points, end exclusive,
    kind an index into KINDS, repos and owners the numbers of distinct ones whose
    texts have the value anywhere in the corpus. A value that more than `few` owners
    or `few_repos` repositories have is a copied example; any other is live. Added spans are long mixed runs
    outside the base spans, and only live ones are reported.

    Null texts are empty; a null owner or repository is one of its own; rows of one id
    and text are copies. Other columns are not read. An empty table gives an empty
    result. Each row's owner is counted once a value before the shuffle by value. The
    spans of frequent values, of which there are SHARE at most, meet their counts by
    broadcast and are not shuffled by value, so a value that stands everywhere makes no hot group.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("_owner"),
        F.coalesce(F.col(repo_col or owner_col).cast("string"), F.lit("\x00")).alias("_repo"),
        text.alias("_text"),
    )
    base = F.concat(*[_found(F.col("_text"), i, p, g, n) for i, (_, p, g, n) in enumerate(BASE)])
    more = F.filter(
        _found(F.col("_text"), len(BASE), *ADDED[1:]), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    )
    rows = rows.select("_id", "_owner", "_repo", F.xxhash64("_text").alias("_copy"), base.alias("base"), more.alias("more"))
    outside = F.filter(
        "more", lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    )
    rows = settle(rows.withColumn("more", outside))
    spans = rows.select("_id", "_owner", "_repo", "_copy", F.explode(F.concat("base", "more")).alias("s"))
    spans = spans.withColumn("h", F.sha2(F.col("s.value"), 256))
    owners = (
        spans.groupBy("h", "_owner", "_repo")
        .agg(F.count("*").alias("n"))
        .groupBy("h")
        .agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_owner", "_repo").alias("repos"), F.sum("n").alias("n"))
    )
    owners = settle(owners)
    total = owners.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * SHARE >= total
    often = F.broadcast(owners.where(frequent).drop("n"))
    at_rest = spans.join(often.select("h"), "h", "left_anti").join(owners.where(~frequent).drop("n"), "h")
    live = (F.col("owners") <= few) & (F.col("repos") <= few_repos)
    rated = (
        spans.join(often, "h")
        .unionByName(at_rest)
        .select(
            "_id",
            "_copy",
            F.struct("s.start", "s.kind", "s.end", "s.value", "repos", "owners", live.alias("live")).alias("s"),
        )
        .where(F.col("s.live") | (F.col("s.kind") < len(BASE)))
        .groupBy("_id", "_copy")
        .agg(F.array_sort(F.collect_set("s")).alias("spans"))
        .toDF("_rid", "_rcopy", "spans")
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,repos:bigint,owners:bigint,live:boolean>>")
    return (
        rows.select("_id", "_copy", "base")
        .join(rated, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_copy") == F.col("_rcopy")), "left")
        .select(F.col("_id").alias(id_col), "base", F.coalesce("spans", none).alias("spans"))
    )


def digest_secrets(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base list, the list of all spans, and how many are live."""
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        id_col,
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )
