import pytest
from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.operators import asking, evaluate, graph, overview, vectors

NODES = [("sig:sig-apps", "sig", "Apps", "public"), ("kep-12", "kep", "Twelve", "internal"), ("kep-7", "kep", "Seven", "restricted"), ("person:ann", "person", "Ann", "public")]
EDGES = [("sig:sig-apps", "OWNS", "kep-12"), ("sig:sig-apps", "OWNS", "kep-7"), ("person:ann", "TECH_LEADS", "sig:sig-apps"), ("person:ann", "CHAIRS", "sig:sig-apps")]


def asked(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, question string")


def test_links(spark):
    texts = ["KEP-0012, kep12 and KEP 7 of SIG Apps or sig-apps", "the SIG of Apps SIG", "ask @Ann- or ann lee?", "joann leeward", "plain words", "@a SIG owns KEP-00"]
    aliases = spark.createDataFrame([("ann lee", "@Ann"), ("c++ (x)", "plus")], "alias string, handle string")
    rows = asking.link(asked(spark, texts), aliases).collect()
    found = {i: [(r.entity_id, r.via) for r in sorted(rows, key=lambda r: r.pos) if r.qid == str(i)] for i in range(len(texts))}
    assert found[0] == [("kep-12", "kep-number"), ("kep-7", "kep-number"), ("sig:sig-apps", "slug"), ("sig:sig-of", "slug"), ("sig:sig-or", "slug")]
    assert found[1] == [("sig:sig-of", "slug"), ("sig:sig-apps", "slug")]
    assert found[2] == [("person:ann", "handle")]  # the name behind the handle is the same person, found later
    assert found[3] == found[4] == []
    assert found[5] == [("kep-0", "kep-number"), ("person:a", "handle")]
    assert asking.link(asked(spark, texts).limit(0), aliases).count() == 0


def test_routes(spark):
    texts = ["Themes of KEP-3?", "Who leads sig-apps?", "broadly, what are the plans", "how does it work", None]
    rows = asked(spark, texts).select("qid", Q.engine(F.coalesce("question", F.lit(""))).alias("r")).orderBy("qid").collect()
    assert [(r.r.engine, r.r.reason) for r in rows] == [
        ("hybrid", "anchor_beats_cue"), ("hybrid", "anchor_no_cue"), ("global", "cue_no_anchor"), ("hybrid", "default_local"), ("hybrid", "default_local"),
    ]
    texts = ["count urn:a:1", "urn:a:1 related to what", "urn:a:1 or https://x/y", "about biz:z", "an overview", "related to nothing", "a discount"]
    rows = asked(spark, texts).select("qid", Q.strategy(F.col("question")).alias("s")).orderBy("qid").collect()
    assert [r.s for r in rows] == ["structured", "graph_expand", "ambiguous", "hybrid_graph", "global", "vector_only", "structured"]
    given = asked(spark, ["x"]).select(Q.strategy(F.col("question"), F.array(F.lit("urn:a"), F.lit("urn:b"))).alias("s")).first()
    assert given.s == "ambiguous"


def test_governed_answers_and_refusals(spark):
    nodes, edges = spark.createDataFrame(NODES, "id string, kind string, title string, tier string"), spark.createDataFrame(EDGES, "src string, kind string, dst string")
    texts = ["Which KEPs does SIG Apps own", "Which KEPs does SIG Nowhere own", "Who owns KEP-12", "SIGs that @ann leads", "Say tech lead of SIG Apps", "anything else"]
    q = asked(spark, texts)
    linked = asking.link(q)
    found = {r.qid: r for r in asking.governed(q, linked, edges, nodes).collect()}
    assert [found[str(i)].outcome for i in range(6)] == ["answered", "unbound", "answered", "answered", "answered", "no_template"]
    assert found["0"].answer == f"Answer to: {texts[0]} Graph facts: kep-12, kep-7." and found["1"].answer is None
    assert found["3"].answer.endswith("Graph facts: sig:sig-apps.") and found["4"].answer.endswith("Graph facts: person:ann.")
    bound = {r.qid: r for r in asking.bind_entities(q.select("qid", Q.template(F.col("question")).alias("template")).where("template is not null"), linked, nodes).collect()}
    assert bound["1"].id is None and set(bound["1"].dropped) == {"sig:sig-nowhere", "sig:sig-does"} and bound["0"].via == "link:slug"


def test_filters_and_values(spark):
    aliases = spark.createDataFrame([("ann lee", "ann")], "alias string, handle string")
    raw = spark.createDataFrame(
        [("1", "source", 0, "community"), ("1", "source", 1, "wiki"), ("1", "entity_ids", 0, "Ann Lee"), ("1", "entity_ids", 1, "nobody"), ("1", "tier", 0, "x")], "qid string, field string, pos int, value string"
    )
    found = {(r.field, r.value, r.reason) for r in asking.checked_filters(raw, aliases, ["community", "enhancements"]).collect()}
    assert found == {
        ("source", "community", None), ("source", "wiki", "not in enum"), ("entity_ids", "person:ann", None), ("entity_ids", "nobody", "no declared-entity match"), ("tier", "x", "undeclared field"),
    }
    row = asked(spark, ["take 3 or 40 betas, not alphabets, 99999999999999999999"]).select(Q.enum_value(F.col("question"), ["alpha", "betas"]).alias("e"), Q.int_value(F.col("question"), 10, 50).alias("i")).first()
    assert (row.e, row.i) == ("betas", 40)


def test_personas(spark):
    personas = spark.createDataFrame(asking.PERSONAS, "persona string, rank int")
    rows = spark.createDataFrame([("1", "member"), ("2", None), ("3", "")], "qid string, persona string")
    got = lambda deny: [r.clearance for r in asking.cleared(rows, personas, deny).orderBy("qid").collect()]
    assert got(True) == [2, 0, 0] and got(False) == [2, None, None]
    with pytest.raises(Exception, match="unknown persona"):
        asking.cleared(spark.createDataFrame([("1", "root")], "qid string, persona string"), personas).collect()


def test_small_functions(spark):
    texts = ["a#b/c#4", "x/y/z", "p#q", "http://h/ü b*+%~"]
    rows = asked(spark, texts).select(Q.local_name(F.col("question")).alias("l"), Q.parent_key(F.col("question")).alias("p"), Q.ordinal(F.col("question")).alias("o"), Q.encoded(F.col("question")).alias("e")).collect()
    assert [(r.l, r.p, r.o) for r in rows[:3]] == [("4", "a#b/c", 4), ("z", "x/y/z", 0), ("q", "p", 0)]
    assert rows[3].e == "http://h/%C3%BC%20b%2A%2B%25~"
    row = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.5' b").select(Q.date_time(F.col("a")).alias("a"), Q.date_time(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.500000Z")


def test_expansion_reads_a_hub_in_part(spark):
    links = [("hub", "E", f"n{i:04d}") for i in range(3000)] + [("n0001", "E", "hub"), ("n0002", "E", "zz")]
    nodes = spark.createDataFrame([(x, "k", "public") for x in {a for a, _, b in links} | {b for _, _, b in links}], "id string, kind string, tier string")
    adj = graph.adjacency(nodes, spark.createDataFrame(links, "src string, kind string, dst string"))
    found = [(r.hop, r.id) for r in graph.expand(spark.createDataFrame([("q", "hub")], "qid string, id string"), adj, cap=3).orderBy("hop", "id").collect()]
    assert found == [(1, "n0000"), (1, "n0001"), (1, "n0002"), (2, "zz")]


def test_blocked_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKED", 5)
    monkeypatch.setattr(vectors, "HELD", 7)
    rows = [(i, [float((i * k) % 11 - 5) for k in range(1, 5)], i % 3, i % 3 + 1, i // 4) for i in range(60)] + [(60, [0.0] * 4, 0, 1, 15), (61, None, 0, 1, 15)]
    chunks = spark.createDataFrame(rows, "chunk_id long, v array<double>, label int, r int, parent_id long")
    q = chunks.where("chunk_id < 12").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"), F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).alias("wanted"), F.lit(2).alias("clearance"))

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0

    got = {}
    for r in vectors.knn(q, chunks, 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, round(r.score, 9)))
    for i in range(12):
        fit = [(c, round(cosine(rows[i][1], v), 9)) for c, v, label, r, _ in rows if v and r <= 2 and (i % 2 or label in (0, 1))]
        best = sorted(fit, key=lambda x: (-x[1], x[0]))[:4]
        assert [(c, s) for _, c, s in sorted(got[i])] == best
    for r in vectors.parents(q.select("qid", "q"), chunks, 2).collect():
        best = {}
        for c, v, _, _, p in rows:
            if v:
                best[p] = min(best.get(p, (9, 0)), (-round(cosine(rows[r.qid][1], v), 9), c))
        order = sorted(best, key=lambda p: (best[p][0], p))
        assert r.parent_id == order[r["rank"] - 1] and r.child == best[r.parent_id][1]
    assert vectors.knn(q, chunks, 0).count() == 0


def test_sets_are_checked(spark):
    schema = "row int, id string, query string, gold array<string>, class string, expect_miss boolean"
    good = (1, "a", "q", ["c"], "semantic", False)
    assert evaluate.question_set(spark.createDataFrame([good], schema)).count() == 1
    with pytest.raises(ValueError, match="row 2, 3"):
        evaluate.question_set(spark.createDataFrame([good, (2, "b", "q", ["c"], "entity", False), (3, None, "q", ["c"], "entity", True)], schema))
    with pytest.raises(ValueError, match="labelled sample: row 1"):
        evaluate.labelled_sample(spark.createDataFrame([(1, "x", "", None)], "row int, raw string, gold string, kind string"))
    vecs = spark.createDataFrame([("chunks", "c", [1.0]), ("queries", "q", [1.0])], "kind string, id string, vector array<double>")
    ids = lambda name, x: spark.createDataFrame([(x,)], f"{name} string")
    assert [df.count() for df in evaluate.frozen(vecs, ids("chunk_id", "c"), ids("id", "q"))] == [1, 1]
    with pytest.raises(ValueError, match="unknown chunk c"):
        evaluate.frozen(vecs, ids("chunk_id", "d"), ids("id", "q"))
    with pytest.raises(ValueError, match="question z"):
        evaluate.frozen(vecs, ids("chunk_id", "c"), ids("id", "z"))
    pairs = spark.createDataFrame([("g1", "p1"), ("g1", "p1"), ("g1", "p2"), ("g2", "p2")], "gold string, pred string")
    r = evaluate.pairwise(pairs).first()
    assert (r.tp, r.fp, r.fn, r.passes) == (1, 1, 2, False)
    one = evaluate.pairwise(pairs.limit(0)).first()
    assert (one.precision, one.recall, one.passes) == (1.0, 1.0, True)


def test_wording_overlap(spark):
    text = "abcdefghijklmnopqrstuvwxyz"
    golds = spark.createDataFrame([(i, "#" * i + text[3:18].upper() + "!!") for i in range(6)] + [(9, text[:11]), (10, None)], "id int, text string")
    found = {(r.id, r.overlap) for r in evaluate.overlaps(spark.createDataFrame([(1, "zz " + text)], "qid int, text string"), golds).collect()}
    assert found == {(i, 15) for i in range(6)}


def test_answers_over_communities(spark):
    told = spark.createDataFrame([("a", ["d2", "d1"]), ("b", ["d1"])], "community string, docs array<string>")
    judged = spark.createDataFrame([(1, 1, "a", " yes ", True), (1, 2, "b", "not NOT RELEVANT", True), (2, 1, "a", "NOT RELEVANT", False)], "qid int, rank int, community string, answer string, relevant boolean")
    found = {r.qid: (r.answer, r.n, r.citations) for r in overview.global_answers(judged, told).collect()}
    assert found == {1: (" yes \nnot NOT RELEVANT", 2, ["community:a", "community:b", "d1", "d2"]), 2: (overview.NOTHING, 0, [])}
    served = judged.select("qid", "rank", "community", "answer")
    again = overview.verdicts(served.drop("answer"), served.select("community", "answer").where("answer like '%NOT%'").distinct(), F.col("answer")).collect()
    assert {(r.answer, r.relevant) for r in again} == {("not NOT RELEVANT", True), ("NOT RELEVANT", False)}
