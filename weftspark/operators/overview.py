"""Communities and what is said of them: members, summaries, and answers over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.operators.graph import rank

#: What an answer is when no community is left.
NOTHING = "No community summaries in scope contribute to this question."


def intra_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, src, kind, dst): the edges (src, kind, dst) with both ends in one community of members (id, community)."""
    a, b = members.toDF("src", "community"), members.toDF("dst", "_other")
    return edges.join(a, "src").join(b, "dst").where(F.col("community") == F.col("_other")).select("community", "src", "kind", "dst")


def summaries(members: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(community, title, size, tier_rank, summary, docs) of members (id, community), nodes (id, title, tier), edges, and docs (id, doc).

    The title is the first member's label and how many more there are, the tier the highest
    of the members'. The summary states members and the relationships within; docs are the
    members' documents, each once. Counts are made before texts, so a community is gathered once, for its text.
    """
    known = members.join(nodes.select("id", Q.label(F.col("title"), F.lit(None).cast("string"), F.col("id")).alias("label"), rank(F.col("tier")).alias("r")), "id")
    one = known.groupBy("community").agg(
        F.count("*").alias("size"), F.min(F.struct("id", "label")).alias("first"), F.max("r").alias("tier_rank"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    line = F.concat("src", F.lit(" -"), "kind", F.lit("-> "), "dst")
    rels = intra_edges(members, edges).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("rels"))
    told = members.join(docs, "id").groupBy("community").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    rows = one.join(rels, "community", "left").join(told, "community", "left")
    asked = F.concat(F.lit("Relationships within the community: "), F.coalesce("rels", F.lit("(no internal relationships)")))
    none = F.array().cast("array<string>")
    more = F.when(F.col("size") > 1, F.concat(F.lit(" +"), (F.col("size") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select(
        "community", F.concat("first.label", more).alias("title"), "size", "tier_rank", Q.answer(asked, none, F.col("ids")).alias("summary"), F.coalesce("docs", none).alias("docs")
    )


def verdicts(served: DataFrame, told: DataFrame, say: Column) -> DataFrame:
    """(qid, rank, community, answer, relevant) of served (qid, rank, community, ...) and what is told of them; say: the answer of a community to a question.

    An answer is irrelevant only if it is, but for white space, the words NOT RELEVANT.
    """
    rows = served.join(told, "community").withColumn("answer", say)
    return rows.select("qid", "rank", "community", "answer", (F.trim("answer") != "NOT RELEVANT").alias("relevant"))


def global_answers(judged: DataFrame, told: DataFrame) -> DataFrame:
    """(qid, answer, n, citations): the relevant answers in their order, and what they rest on: the communities, then their documents, each once."""
    kept = judged.where("relevant").join(told.select("community", "docs"), "community")
    one = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "answer", "community"))).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("d"))
    rows = judged.select("qid").distinct().join(one, "qid", "left")
    none = F.array().cast("array<string>")
    cited = F.concat(F.transform("c", lambda x: F.concat(F.lit("community:"), x["community"])), F.col("d"))
    return rows.select(
        "qid", F.coalesce(F.array_join(F.transform("c", lambda x: x["answer"]), "\n"), F.lit(NOTHING)).alias("answer"), F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("n"), F.coalesce(cited, none).alias("citations")
    )
