from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import delta, documents, graph, vectors


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_identity(spark):
    df = spark.createDataFrame([("@@Tim ", "SIG Node!", "kep-0009"), ("a", "--x--", "000")], "h string, s string, k string")
    assert rows(df.select(T.handle(df.h), T.slug(df.s), T.numbered(df.k))) == [("a", "x", "kep-0"), ("tim", "sig-node", "kep-9")]


def test_capped_expansion_matches_a_plain_walk(spark):
    nodes = spark.createDataFrame([(f"n{i}", "n", "restricted" if i == 4 else "public") for i in range(9)], "id string, kind string, tier string")
    links = [("n0", "E", f"n{i}") for i in (5, 3, 4, 7)] + [("n3", "E", "n8"), ("n5", "E", "n6"), ("n8", "E", "gone")]
    adj = graph.adjacency(nodes, spark.createDataFrame(links, "src string, kind string, dst string"))
    seeds = spark.createDataFrame([("q", "n0")], "qid string, id string")
    assert rows(graph.expand(seeds, adj, cap=2)) == [("q", "n3", 1), ("q", "n4", 1), ("q", "n8", 2)]
    assert rows(graph.expand(seeds, adj, cap=2, clearance=1)) == [("q", "n3", 1), ("q", "n5", 1), ("q", "n6", 2), ("q", "n8", 2)]
    assert rows(graph.expand(seeds, adj, clearance=0)) == []


def test_moves_pair_in_order(spark):
    before = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h3")], "doc_id string, hash string")
    after = spark.createDataFrame([("x", "h1"), ("c", "h4"), ("d", "h5")], "doc_id string, hash string")
    found = delta.with_moves(delta.diff(before, after))
    assert rows(found.select("action", "doc_id")) == [("added", "d"), ("changed", "c"), ("deleted", "b"), ("moved", "a")]


def test_first_writer_wins_even_with_null(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "s", 1, {"k": None}), ("a", "t", 2, {"k": "v", "l": "w"})], "id string, source string, ord int, props map<string,string>")
    one = graph.resolve(df, ["id"]).select("sources", F.col("props")["k"], F.col("props")["l"]).first()
    assert tuple(one) == (["s", "t"], None, "w")


def test_knn_filter_stands_below_the_rank(spark):
    chunks = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(8)], "chunk_id long, v array<float>, odd int")
    asked = spark.createDataFrame([(1, [1.0, 0.0], [1])], "qid long, q array<float>, wanted array<int>")
    found = vectors.knn(asked, chunks.withColumnRenamed("odd", "label"), 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [1, 3, 5]


def test_shapes(spark):
    quads = spark.createDataFrame(
        [("n", "d", "type", "Policy", "iri"), ("n", "d", "name", "x", "string"), ("n", "d", "effectiveDate", "soon", "date"), ("n", "d", "effectiveDate", "2024-01-01", "date"), ("n", "d", "gitCommitSHA", "c", "string"), ("n", "d", "hasPII", "true", "boolean")],
        "g string, s string, p string, o string, o_type string",
    )
    broken = documents.violations(quads, documents.shapes(spark))
    assert rows(broken.select("s", "path", "rule")) == [("d", "effectiveDate", "datatype"), ("d", "effectiveDate", "maxCount"), ("d", "scope", "minCount")]
    assert rows(documents.gated(quads, broken)) == [("d", "quarantined", "effectiveDate:datatype;effectiveDate:maxCount;scope:minCount")]
    assert rows(documents.gated(quads, broken.limit(0))) == [("d", "loaded", "")]


def test_exhaustive_retrieval_has_no_limit(spark):
    quads = spark.createDataFrame([("normative", f"d{i}", "type", "Policy", "iri") for i in range(300)], "g string, s string, p string, o string, o_type string")
    assert documents.normative(quads, "2024-01-01").count() == 300


def test_published_snapshot(spark, tmp_path):
    root = str(tmp_path / "t")
    delta.publish(spark.range(3), root, 1)
    delta.publish(spark.range(5), root, 2)
    assert delta.published(spark, root).count() == 5


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_screened_queries(spark):
    """Every rule and limit, each with a literal."""
    from weftspark.functions import text as T

    ok = "MATCH (n {id: 'x'}) RETURN n"
    cases = {
        "": "empty", " \n\t": "empty", ";": "multiple_statements", "RETURN 1; RETURN 2": "multiple_statements", ok + " LIMIT 5; CREATE (m)": "multiple_statements",
        "MATCH (n) CREATE (m) RETURN n": "forbidden_clause", "match (n) set n.k='S' return n": "forbidden_clause", "MATCH (n) MERGE (m) RETURN n": "forbidden_clause",
        "MATCH (n) DETACH DELETE n": "forbidden_clause", "MATCH (n) REMOVE n.k RETURN n": "forbidden_clause", "DROP INDEX foo": "forbidden_clause", "CALL db.labels() YIELD l RETURN l": "forbidden_clause",
        ok + " LIMIT 5 // harmless\nCREATE (m)": "forbidden_clause", "MATCH (n) WHERE n.t CONTAINS 'how to DELETE' RETURN n": "forbidden_clause", "MATCH (n) WHERE n.settled RETURN n": "MATCH (n) WHERE n.settled RETURN n LIMIT 100",
        "MATCH (n) WHERE n.k = 'SIG'": "one_return", "MATCH (n) RETURN n UNION MATCH (m) RETURN m": "one_return",
        "MATCH (a)-[*]->(b) RETURN b": "unbounded_path", "MATCH (a)-[r:REL*..]->(b) RETURN b": "unbounded_path", "MATCH (a)-[r:REL*2..]->(b) RETURN b": "unbounded_path",
        "MATCH (a)-[r:REL* 2 .. ]->(b) RETURN b": "unbounded_path", "MATCH (a)-[ * {x: 1}]->(b) RETURN b": "unbounded_path",
        "MATCH (a)-[r:REL*1..2]->(b) RETURN b LIMIT 5": "MATCH (a)-[r:REL*1..2]->(b) RETURN b LIMIT 5", "MATCH (a)-[*..3]->(b) RETURN b LIMIT 5": "MATCH (a)-[*..3]->(b) RETURN b LIMIT 5",
        "MATCH (a)-[r:REL*2]->(b) RETURN b LIMIT 5": "MATCH (a)-[r:REL*2]->(b) RETURN b LIMIT 5",
        ok: ok + " LIMIT 100", f"  {ok} ; ": ok + " LIMIT 100", f"{ok};;": ok + " LIMIT 100", ok + " LIMIT 5;": ok + " LIMIT 5", ok + " LIMIT 5000;": ok + " LIMIT 100",
        ok + " limit 100000": ok + " limit 100", ok + " LIMIT 99999999999": ok + " LIMIT 100", ok + " LIMIT " + "9" * 60: ok + " LIMIT 100", ok + " LIMIT 0000000000000000000000000000000000000000000007": ok + " LIMIT 0000000000000000000000000000000000000000000007",
        ok + " LIMIT 100 SKIP 2": ok + " LIMIT 100 SKIP 2", "MATCH (n) WITH n LIMIT 500 RETURN n LIMIT 7": "MATCH (n) WITH n LIMIT 100 RETURN n LIMIT 7", ok + " LIMIT\n101": ok + " LIMIT\n100",
    }
    rows = spark.createDataFrame(list(cases.items()), "q string, expected string").withColumn("got", T.screened(F.col("q")))
    assert [tuple(r) for r in rows.where("not (got <=> expected)").collect()] == []
    capped = spark.createDataFrame([(ok + " LIMIT 100000",)], "q string").select(T.screened(F.col("q"), 25).alias("v")).first().v
    assert capped == ok + " LIMIT 25"


def test_long_white_space_and_digits(spark):
    import time

    from weftspark.functions import questions as Q
    from weftspark.functions import text as T

    rows = spark.createDataFrame([("　 a" + " " * 1_000_000 + "b\x85\n", "x#" + "9" * 40), ("", "x#007"), (None, None), (" \t", "x#"), ("a", "x#9223372036854775807")], "t string, c string")
    began = time.time()
    got = [tuple(r) for r in rows.select(T.stripped(F.col("t")), Q.ordinal(F.col("c")), T.is_header(F.col("t"))).collect()]
    assert got == [("a" + " " * 1_000_000 + "b", 2**63 - 1, False), ("", 7, False), (None, 0, None), ("", 0, False), ("a", 2**63 - 1, False)]
    assert time.time() - began < 15
