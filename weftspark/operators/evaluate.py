"""Evaluation of resolution, retrieval and labelled sets, and checks of the sets themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.state import few

#: The least precision and recall that a resolver passes with.
BAR = 0.8


def pairwise(mentions: DataFrame, bar: float = BAR) -> DataFrame:
    """(tp, fp, fn, precision, recall, passes) of mentions (gold, pred): pairs put together rightly, wrongly and not.

    Pairs are counted from contingency counts, never made. Without any pair a rate is 1.
    """
    counts = mentions.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    two = lambda n: F.sum(F.floor(n * (n - 1) / 2)).cast("long")
    by = lambda side: counts.groupBy(side).agg(F.sum("n").alias("m")).select(F.lit(side).alias("of"), F.col("m").alias("n"))
    every = counts.select(F.lit("both").alias("of"), "n").unionByName(by("gold")).unionByName(by("pred"))
    sums = every.agg(*[two(F.when(F.col("of") == x, F.col("n"))).alias(x) for x in ("both", "gold", "pred")])
    sums = sums.select(*[F.coalesce(x, F.lit(0)).alias(x) for x in ("both", "gold", "pred")])
    rate = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.col("both") / F.col(of))
    passes = (rate("pred") >= bar) & (rate("gold") >= bar)
    return sums.select(
        F.col("both").alias("tp"), (F.col("pred") - F.col("both")).alias("fp"), (F.col("gold") - F.col("both")).alias("fn"),
        F.round(rate("pred"), 6).alias("precision"), F.round(rate("gold"), 6).alias("recall"), passes.alias("passes"),
    )


def ranks(gold: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, expect_miss, rank, present): the first rank of a gold chunk among the hits, null if none, and whether every gold chunk exists."""
    there = chunks.select(F.col("chunk_id").alias("gold"), F.lit(1).alias("there"))
    found = gold.join(hits.select("qid", F.col("chunk_id").alias("gold"), "rank"), ["qid", "gold"], "left").join(there, "gold", "left")
    return found.groupBy("qid", "expect_miss").agg(F.min("rank").alias("rank"), (F.count("there") == F.count("*")).alias("present"))


def retrieval(gold: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hit_rate, mrr, passes) of gold (qid, expect_miss, gold) over hits (qid, rank, chunk_id).

    It passes if every other question is hit and every expected miss has its gold chunks in the corpus and none among the hits.
    """
    one = ranks(gold, hits, chunks)
    counts, hit = ~F.col("expect_miss"), F.col("rank").isNotNull()
    rate = lambda x: F.round(F.coalesce(F.avg(F.when(counts, x)), F.lit(1.0)), 6)
    good = F.when(counts, hit).otherwise(F.col("present") & ~hit)
    return one.agg(rate(hit.cast("int")).alias("hit_rate"), rate(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.coalesce(F.bool_and(good), F.lit(True)).alias("passes"))


def refused(rows: DataFrame, ok: Column, what: str) -> DataFrame:
    """rows, unless some break the rule: then an error that names their numbers (column `row`)."""
    bad = rows.where(~F.coalesce(ok, F.lit(False))).agg(F.array_join(F.array_sort(F.collect_list("row")), ", ").alias("rows")).first()["rows"]
    if bad:
        raise ValueError(f"{what}: row {bad}")
    return rows


def question_set(rows: DataFrame) -> DataFrame:
    """A question set (row, id, query, gold, class, expect_miss): every row has its fields, and misses are expected of class `entity` alone."""
    told = F.col("id").isNotNull() & F.col("query").isNotNull() & (F.size("gold") > 0) & F.col("class").isin("semantic", "entity")
    return refused(rows, told & ((F.col("class") == "entity") == F.col("expect_miss")), "question set")


def labelled_sample(rows: DataFrame) -> DataFrame:
    """Labelled mentions (row, raw, gold, kind): raw and gold are required, the kind is `person` unless told."""
    return refused(rows, (F.col("raw") != "") & (F.col("gold") != ""), "labelled sample").withColumn("kind", F.coalesce("kind", F.lit("person")))


def frozen(vectors: DataFrame, chunks: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk vectors, question vectors) of frozen (kind, id, vector); a vector of an unknown chunk or a question without one is an error."""
    of = lambda kind: vectors.where(F.col("kind") == kind)
    unknown = of("chunks").join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti").select("id").first()
    if unknown is not None:
        raise ValueError(f"frozen vector for unknown chunk {unknown['id']}")
    missing = questions.select("id").join(of("queries").select("id"), "id", "left_anti").first()
    if missing is not None:
        raise ValueError(f"no frozen vector for question {missing['id']}")
    return of("chunks").select("id", "vector"), of("queries").select("id", "vector")


def gold_checks(gold: DataFrame, got: DataFrame) -> DataFrame:
    """(qid, kind, wanted, missing, passes) of gold (qid, kind, id) against got (qid, id).

    Ids of kind `visible` or `expected` must be among the results, those of kind `filtered` or `excluded` must not.
    """
    held = got.select("qid", "id", F.lit(True).alias("got")).distinct()
    want = F.col("kind").isin("visible", "expected")
    found = gold.join(held, ["qid", "id"], "left").withColumn("bad", want != F.coalesce("got", F.lit(False)))
    return found.groupBy("qid", "kind").agg(
        F.count("*").alias("wanted"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("id")))), ",").alias("missing"), (F.count_if("bad") == 0).alias("passes")
    )


def _states(text: str) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """The suffix automaton of a text: next states by character, suffix links and longest lengths."""
    next_, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new, at = len(next_), last
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and c not in next_[at]:
            next_[at][c] = new
            at = link[at]
        if at >= 0:
            to = next_[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(next_)
                next_.append(dict(next_[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and next_[at].get(c) == to:
                    next_[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return next_, link, length


def longest_common(automaton: tuple[list[dict[str, int]], list[int], list[int]], text: str) -> int:
    """Length of the longest substring of a text that the automaton's text has as well; one pass over the text."""
    next_, link, length = automaton
    at = size = best = 0
    for c in text:
        while at and c not in next_[at]:
            at = link[at]
            size = length[at]
        if c in next_[at]:
            at, size = next_[at][c], size + 1
            best = max(best, size)
    return best


@F.pandas_udf(T.LongType())
def common_length(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common substring of two texts, letters folded; 0 if one is null. Time is linear in both."""
    for a, b in pairs:
        out, known, automaton = [], None, None
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").lower(), (y or "").lower()
            if known is None or x != known:
                known, automaton = x, _states(x)
            out.append(longest_common(automaton, y))
        yield pd.Series(out, dtype="int64")


common_length = common_length.asNondeterministic()  # else a filter on it measures every pair twice


def overlaps(questions: DataFrame, golds: DataFrame, least: int = 12, shingle: int | None = None) -> DataFrame:
    """(qid, id, overlap) of questions (qid, text) and texts (id, text) with a common substring of `least` characters or more.

    Texts are cut at every `step` characters into seeds of `shingle`, so that whatever has `least` characters holds
    a seed in full. Seeds meet all runs of the questions, each with the characters before and after it
    that can belong to what is to be found: only pairs that have `least` characters in common there are kept, so common wording leads to no pair.
    These are measured on the whole texts. Null texts overlap with nothing. Few questions go to every task, so texts aren't shuffled.
    """
    shingle = shingle or max(1, least * 3 // 4)
    step = least - shingle + 1
    if step < 1:
        raise ValueError("a seed must fit what is to be found")
    around = step - 1
    low = F.lower(F.col("text"))

    def windows(rows: DataFrame, key: str, by: int, filler: str, name: str) -> DataFrame:
        """(key, run, name): seeds at every `by` characters, and these with what is around them; before the text stand fillers."""
        found = F.regexp_extract_all(F.concat(F.lit(filler * around), low), F.lit(f"(?s)(?=(.{{{around + shingle},{around + least}}})).{{{by}}}"), F.lit(1))
        held = rows.where(F.length(low) >= least).select(key, F.explode(found).alias(name))
        return held.select(key, F.substring(name, step, shingle).alias("run"), name)

    own = few(windows(questions, "qid", 1, "\0", "_own").distinct())
    seeds = windows(golds, "id", step, "\1", "_held")
    part = lambda name, i: F.substr(F.col(name), i, F.lit(least))
    same = F.exists(F.sequence(F.lit(1), F.lit(step)), lambda i: (part("_own", i) == part("_held", i)) & (F.length(part("_own", i)) == least))
    pairs = few(seeds.join(own, "run").where(same).select("qid", "id").distinct())
    told = golds.select("id", F.col("text").alias("b")).join(pairs, "id").join(questions.select("qid", F.col("text").alias("a")), "qid")
    return told.select("qid", "id", common_length("a", "b").alias("overlap")).where(F.col("overlap") >= least)
