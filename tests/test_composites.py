from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import graph, grounding, hybrid


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_question_seeds_come_first_in_the_budget(spark):
    asked = spark.createDataFrame([("q", "b", 1), ("q", "gone", 2)], "qid string, id string, pos int")
    near = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, id string, pos int")
    assert rows(hybrid.seed_budget(asked, near, 3)) == [("q", "a", 3), ("q", "b", 1), ("q", "gone", 2)]
    nodes = spark.createDataFrame([("a", "n", "public"), ("b", "n", "public"), ("c", "n", "restricted"), ("d", "n", "public")], "id string, kind string, tier string")
    adj = graph.adjacency(nodes, spark.createDataFrame([("b", "E", "d"), ("b", "E", "c")], "src string, kind string, dst string"))
    found = hybrid.seed_and_expand(asked, near, nodes, adj, seed_cap=3, clearance=1).select("qid", "id", "hop")
    assert rows(found) == [("q", "a", 0), ("q", "b", 0), ("q", "d", 1)]


def test_global_answers(spark):
    sized = spark.createDataFrame([("x", 5, 1), ("y", 9, 3), ("z", 5, 1)], "community string, size long, r int")
    asked = spark.createDataFrame([("low", 1), ("high", 3)], "qid string, r int")
    assert rows(hybrid.served(sized, asked, 2)) == [("high", "x", 5, 2), ("high", "y", 9, 1), ("low", "x", 5, 1), ("low", "z", 5, 2)]
    told = spark.createDataFrame([("a", 2, "c", "two"), ("a", 1, "b", "one"), ("a", 3, "d", " NOT RELEVANT\n"), ("b", 1, "c", "NOT RELEVANT")], "qid string, rank int, community string, answer string")
    told = told.withColumn("answer", F.regexp_replace("answer", "\n", ""))
    assert rows(hybrid.reduce_verdicts(told)) == [("a", "one\ntwo", 2), ("b", "No community is relevant.", 0)]


def test_triples_break_the_first_rule_and_ground_by_kind(spark):
    schema = spark.createDataFrame([("HAS", "a", "b"), ("ODD", None, "b")], "predicate string, src_kind string, dst_kind string")
    claims = [(1, None, "HAS", "y"), (2, "x", "HAS", " "), (3, "x", "has", "y"), (4, "x", "NEW", "y"), (5, "x", "ODD", "y"), (6, " X ", "HAS", "y"), (7, "x", "HAS", "x"), (8, "x", None, "y")]
    judged = grounding.triple_verdicts(spark.createDataFrame(claims, "cid int, subject string, predicate string, object string"), schema)
    assert {r["cid"]: r["rule"] for r in judged.collect()} == {
        1: "empty-subject", 2: "empty-object", 3: "malformed-predicate", 4: "off-schema-predicate", 5: "unknown-endpoint-kind", 6: None, 7: None, 8: "malformed-predicate",
    }
    nodes = spark.createDataFrame([("x", "a"), ("y", "b")], "id string, kind string")
    assert rows(grounding.ground(judged.where("rule is null"), nodes)) == [(6, "x", "y")]


def test_replies_are_read_or_give_nothing(spark):
    one = '{"subject":"s","predicate":"P","object":"o"}'
    replies = [(1, f"```json\n[{one}]\n```"), (2, f"so: [{one},{one}] done"), (3, "[{"), (4, None), (5, "[]")]
    found = grounding.reply_triples(spark.createDataFrame(replies, "rid int, reply string"), most=1)
    assert rows(found.select("rid", "subject", "object")) == [(1, "s", "o"), (2, "s", "o")]


def test_decisions_bindings_and_context(spark):
    asked = spark.createDataFrame([("a", "r"), ("zzz", "r"), (None, "r")], "proposed string, fallback string")
    found = grounding.checked_decisions(asked, ["a", "b"])
    assert rows(found.select("decision", "decided_by")) == [("a", "model"), ("r", "rule"), ("r", "rule")]
    nodes = spark.createDataFrame([("n1", "k"), ("n2", "k"), ("n0", "other")], "id string, kind string")
    named = spark.createDataFrame([("q", "n0", 1), ("q", "n2", 2), ("q", "n1", 3), ("p", "none", 1)], "qid string, id string, pos int")
    assert rows(grounding.first_confirmed(named, nodes, "k")) == [("p", None, 1), ("q", "n2", 1)]
    hits = spark.createDataFrame([("q", 2, "b", "two"), ("q", 1, "a", "one")], "qid string, rank int, label string, body string")
    assert rows(grounding.contexts(hits)) == [("q", "[a] one\n[b] two")]
    assert rows(grounding.contexts(hits, most=5)) == [("q", "[a] o")]


def test_logged_triple_queries(spark):
    logged = ["SELECT ?s FROM NAMED <g> WHERE { ?s a ?t }", "INSERT DATA { }", "SELECT ?s WHERE { SERVICE <x> { } }", "ASK { }", "SELECT ?s { }", "SELECT ?s FROM NAMED <g> { ?s <p>* ?o }"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(logged)], "i int, t string")
    found = [r["v"] for r in df.orderBy("i").select(T.screened_sparql(df.t).alias("v")).collect()]
    assert found == ["ok", "mutation", "service", "not_select", "no_from_named", "unbounded_path"]
