"""Candidate triples checked against a schema and a graph, and replies read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triple_verdicts(candidates: DataFrame, schema: DataFrame) -> DataFrame:
    """candidates (subject, predicate, object, ...) with rule, the first that each breaks (null if none), and both ends' kinds.

    schema (predicate, src_kind, dst_kind) is the list of edge kinds; it grows with the model, not with the data.
    """
    kinds = schema.select(F.col("predicate").alias("known"), "src_kind", "dst_kind")
    found = candidates.join(kinds, F.col("predicate") == F.col("known"), "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rule = (
        F.when(blank("subject"), "empty-subject")
        .when(blank("object"), "empty-object")
        .when(~F.coalesce(F.col("predicate").rlike("^[A-Z][A-Z_]*$"), F.lit(False)), "malformed-predicate")
        .when(F.col("known").isNull(), "off-schema-predicate")
        .when(F.col("src_kind").isNull() | F.col("dst_kind").isNull(), "unknown-endpoint-kind")
    )
    return found.withColumn("rule", rule).drop("known")


def ground(candidates: DataFrame, nodes: DataFrame, normal: Column | None = None) -> DataFrame:
    """(cid, src, dst) of candidates (cid, subject, object, src_kind, dst_kind) whose ends both exist with the schema's kinds.

    Each end is looked up as it stands and else in the form `normal` makes of the column
    `text`; all ends of all candidates take one join.
    """
    ends = candidates.select("cid", F.explode(F.array(
        F.struct(F.lit("src").alias("end"), F.col("subject").alias("text"), F.col("src_kind").alias("kind")),
        F.struct(F.lit("dst").alias("end"), F.col("object").alias("text"), F.col("dst_kind").alias("kind")),
    )).alias("e")).select("cid", "e.*")
    tries = F.array(F.col("text"), normal if normal is not None else F.lower(F.trim("text")))
    tried = ends.select("cid", "end", "kind", F.posexplode(tries).alias("turn", "id"))
    held = tried.join(nodes.select("id", "kind"), ["id", "kind"]).groupBy("cid", "end").agg(F.min_by("id", "turn").alias("id"))
    pick = lambda end: F.max(F.when(F.col("end") == end, F.col("id")))
    return held.groupBy("cid").agg(pick("src").alias("src"), pick("dst").alias("dst")).where("src is not null and dst is not null")


TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


def reply_triples(replies: DataFrame, most: int = 20) -> DataFrame:
    """(rid, n, subject, predicate, object): triples of the JSON array in each reply (rid, reply), fenced or not.

    A reply that can't be read gives nothing; one gives its first `most` triples, as the feature's own bound.
    """
    listed = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), TRIPLES)
    return replies.select("rid", F.posexplode(F.slice(listed, 1, most)).alias("n", "t")).where("t is not null").select("rid", "n", "t.*")


def reply_filters(replies: DataFrame) -> DataFrame:
    """(rid, field, pos, value): what the JSON object in each reply (rid, reply) filters by, a text or a list of texts a field; garbled ones give nothing."""
    told = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "map<string,string>")
    listed = replies.select("rid", F.explode(told).alias("field", "said"))
    values = F.when(F.ltrim("said").startswith("["), F.from_json("said", "array<string>")).otherwise(F.array("said"))
    return listed.select("rid", "field", F.posexplode(values).alias("pos", "value")).where("value is not null")


def checked_decisions(decisions: DataFrame, allowed: list[str]) -> DataFrame:
    """decisions (proposed, fallback, ...) with decision and decided_by: what lies outside the closed set falls back to the rule's."""
    good = F.coalesce(F.col("proposed").isin(allowed), F.lit(False))
    return decisions.withColumn("decision", F.when(good, F.col("proposed")).otherwise(F.col("fallback"))).withColumn(
        "decided_by", F.when(good, "model").otherwise("rule")
    )


def first_confirmed(candidates: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(qid, bound, unconfirmed): of candidates (qid, id, pos) the first that is a node of the kind, and how many are none."""
    known = nodes.where(F.col("kind") == kind).select("id", F.lit(True).alias("known"))
    looked = candidates.join(known, "id", "left")
    return looked.groupBy("qid").agg(
        F.min_by("id", F.when(F.col("known"), F.struct("pos", "id"))).alias("bound"), F.count_if(F.col("known").isNull()).alias("unconfirmed")
    )


def cut_question(question: Column, most: int = 4_000) -> Column:
    """A question as a prompt may hold it."""
    return F.substring(question, 1, most)


def contexts_with_facts(hits: DataFrame, facts: DataFrame, most: int = 24_000) -> DataFrame:
    """(qid, context): as `contexts`, and after the hits the facts (qid, pos, id, kind, title) of each question, one a line."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" - "), "title")).otherwise("")
    lines = hits.select("qid", F.struct(F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"), F.concat(F.lit("["), "label", F.lit("] "), "body").alias("line")).alias("x"))
    lines = lines.unionByName(facts.select("qid", F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("at"), F.concat(F.lit("* "), "id", F.lit(" ("), "kind", F.lit(")"), title).alias("line")).alias("x")))
    told = lines.groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return told.select("qid", F.substring(F.array_join(F.transform("x", lambda y: y["line"]), "\n"), 1, most).alias("context"))


def contexts(hits: DataFrame, most: int = 24_000) -> DataFrame:
    """(qid, context): the hits (qid, rank, label, body) of each question in their order, at most `most` characters."""
    order = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "label", F.lit("] "), "body").alias("line"))))
    return hits.groupBy("qid").agg(F.substring(F.array_join(F.transform(order, lambda x: x["line"]), "\n"), 1, most).alias("context"))
