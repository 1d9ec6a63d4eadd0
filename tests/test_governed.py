import pytest
from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import community, delta, documents, ingest, state
from weftspark.sources import ledger

WORDS = "A line of prose that is long enough to be one. " * 6


def test_cleansing(spark):
    texts = [
        "short", "x" * 199, "x" * 200, "ab \n" * 80, "# h\n" + "ab \n" * 80, f"Page 2 of 9\n  page 3 \n12\n-- 4 --\nconfidential\nINTERNAL  USE ONLY: x\nConfidentiality\n{WORDS}",
        WORDS + "\x01" * 9, "\x01\x02" * 300 + WORDS, WORDS + "mail a.b@c.org, +44 20 7946 0958, 415-555-0199, AB 12 34 56 C", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = T.cleansed(df).orderBy("i").collect()
    assert [r.gate_failed for r in rows[:5]] == ["min_content (observed: 5 chars)", "min_content (observed: 199 chars)", None, "structure", None]
    assert rows[5].headers_stripped == 6 and rows[5].clean_text.startswith("Confidentiality\n") and not rows[5].quarantined
    assert (rows[6].binary_stripped, rows[7].binary_stripped) == (0, 1) and rows[7].clean_text == WORDS and rows[6].clean_text == texts[6]
    assert rows[8].pii_flagged and not rows[8].quarantined and rows[8].pii_entities >= 4 and not rows[2].pii_flagged
    assert rows[9].gate_failed == "min_content (observed: 0 chars)" and rows[3].gates_passed == "min_content"
    assert T.cleansed(df.limit(0)).count() == 0


def test_sections_and_windows(spark):
    text = "intro\n# One \n\nfirst\n  ## Two\n   \n#\n" + "y" * 1701
    got = [(r.ordinal, r.heading, len(r.text)) for r in T.section_chunks(spark.createDataFrame([(1, text), (2, None), (3, "# only")], "doc int, text string"), ["doc"]).orderBy("doc", "ordinal").collect()]
    assert got == [(0, "", 5), (1, "One", 5), (2, "", 1000), (3, "", 851), (4, "", 1)]


def test_sentences(spark):
    text = " ".join(["a" * 1000 + ".", "b" * 200 + "!", "c" * 900 + "?", "d" * 40 + ".", "e" * 3000 + ".", "f."])
    got = [r.text for r in T.sentences(spark.createDataFrame([(1, text), (2, "  ")], "doc_id int, text string")).orderBy("ordinal").collect()]
    parts = text.split(" ")
    assert got == [" ".join(parts[:2]), " ".join(parts[1:4]), " ".join(parts[3:5]), parts[5]]


def test_processing_isolates_failures(spark):
    good = "---\ntitle: T\neffective_date: 2024-01-01\nscope: HR\n---\n" + WORDS
    files = spark.createDataFrame([("policies/a.md", "s1", good), ("policies/b.md", "s2", WORDS), ("sops/c.PPTX", "s3", WORDS), ("sops/d.exe", "s4", good), ("sops/e.md", "s5", "no"), ("policies/f.md", "s6", good.replace("2024-01-01", "soon"))], "path string, sha string, text string")
    outcomes, quads, chunks = documents.process(files, spark, "o/r")
    told = {r.path: (r.outcome, r.reason) for r in outcomes.collect()}
    assert told["policies/a.md"] == ("loaded", None) and told["sops/c.PPTX"] == ("loaded", None)
    assert told["policies/b.md"] == ("quarantined", "effectiveDate:minCount;scope:minCount") and told["policies/f.md"] == ("quarantined", "effectiveDate:datatype")
    assert told["sops/d.exe"] == ("error", "unsupported extension: .exe") and told["sops/e.md"][1].startswith("gate failed: min_content")
    assert {r.s for r in chunks.collect()} == {"urn:doc:policies/a.md", "urn:doc:sops/c.PPTX"}
    assert {r.o for r in quads.where("p = 'extractorUsed'").collect()} == {"passthrough", "markitdown"}
    store = quads.unionByName(documents.taxonomy(quads))
    changes = spark.createDataFrame([("modified", "policies/a.md"), ("deleted", "sops/c.PPTX"), ("added", "x/missing.md"), ("added", "sops/d.exe")], "action string, path string")
    after, rows = documents.medallion(store, changes, files.where("path <> 'policies/a.md'").unionByName(spark.createDataFrame([("policies/a.md", "s9", good.replace("T\n", "U\n", 1))], files.schema)), spark, "o/r")
    assert {(r.p, r.o) for r in after.where("p in ('name', 'inPartition')").collect()} == {("name", "U"), ("inPartition", "urn:graph:normative")}
    assert {r.path: r.reason for r in rows.collect()} == {"policies/a.md": None, "x/missing.md": "file is missing", "sops/d.exe": "unsupported extension: .exe"}
    assert {r.path for r in documents.pending(rows).collect()} == {"x/missing.md", "sops/d.exe"}


def test_policies(spark):
    quads = spark.createDataFrame(
        [("normative", s, p, o, t) for s, facts in {
            "a": [("type", "Policy", "iri"), ("name", "A", "string"), ("effectiveDate", "2024-01-01", "date"), ("inDomain", "HR", "string"), ("inDomain", "Ops", "string"), ("scope", "all", "string")],
            "b": [("type", "Guideline", "iri"), ("effectiveDate", "2030-01-01", "date"), ("hasPII", "true", "boolean")], "c": [("type", "Standard", "iri"), ("effectiveDate", "2020-01-01", "string")], "d": [("type", "SOP", "iri")],
        }.items() for p, o, t in facts], "g string, s string, p string, o string, o_type string",
    )
    got = lambda **k: {r.s for r in documents.normative(quads, "2024-06-30", **k).collect()}
    assert got() == {"a"} and got(include_future=True) == {"a", "b", "c"} and got(domain="Ops") == {"a"} and got(domain="X") == set()
    with pytest.raises(ValueError, match="unknown domain"):
        got(domain="X", domains=["HR", "Ops"])
    hits = spark.createDataFrame([("q", "a", "Policy", 0.9, False), ("q", "z", "Policy", 0.8, True), ("q", "z", "Policy", 0.7, True)], "qid string, s string, kind string, score double, pii boolean")
    legs = {(r.qid, r.s, r.leg, r.relevance, r.withheld) for r in documents.retrieve(documents.normative(quads, "2024-06-30"), hits).collect()}
    assert legs == {(None, "a", "structured", None, False), ("q", "z", "vector", 0.8, True)}
    with pytest.raises(Exception, match="domain is required"):
        documents.policies_by_domain(quads, spark.createDataFrame([(1, None)], "qid int, domain string")).collect()
    nodes, edges = documents.subgraph(spark.createDataFrame([(1, "a")], "qid int, uri string"), quads)
    assert {r.type for r in nodes.where("uri = 'all'").collect()} == {"literal"} and edges.count() == 6


def test_removal_takes_chunks_and_taxonomy(spark):
    quads = spark.createDataFrame(
        [("n", "d", "type", "Policy", "iri"), ("n", "c1", "wasDerivedFrom", "d", "iri"), ("n", "c1", "chunkIndex", "0", "integer"), ("taxonomy", "d", "inPartition", "urn:graph:n", "iri"), ("n", "e", "type", "SOP", "iri")],
        "g string, s string, p string, o string, o_type string",
    )
    assert [r.s for r in documents.removed(quads, spark.createDataFrame([("d",)], "s string")).collect()] == ["e"]


def test_files_at_commits(spark):
    lines = ["A\ta b.md", "M\tm.md", "D\td.md", "R087\told.md\tnew.md", "R100\tlone", "C100\tx\ty", "M", "  ", "T\tt.md"]
    got = [tuple(r) for r in state.name_status(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("added", "a b.md", None), ("modified", "m.md", None), ("deleted", "d.md", None), ("deleted", "old.md", None), ("added", "new.md", "old.md")]
    assert state.watermark(" 0a1b2c3d\n") == "0a1b2c3d" and state.watermark("HEAD; rm") is None and state.watermark(None) is None
    raw = spark.createDataFrame([(1, bytearray(b"ok \xff!"))], "i int, content binary")
    assert documents.decoded(raw).first().text == "ok �!"
    said = spark.createDataFrame([("word " * 3 + "\x0c",), ("word " * 30,), (" \x0c ",)], "t string").select(documents.is_scanned(F.col("t")).alias("s")).collect()
    assert [r.s for r in said] == [True, False, True]


def test_states(spark, tmp_path):
    root = f"{tmp_path}/s"
    assert state.version_of(spark, root) is None
    with pytest.raises(FileNotFoundError):
        state.published(spark, root)
    current = spark.createDataFrame([("a", "0a"), ("b", "0b"), ("c", "zz")], "doc_id string, hash string")
    old = spark.createDataFrame([("a", "0a", "k"), ("b", "ff", "k")], "doc_id string, content_hash string, silver_candidates string")
    rows = {r.doc_id: r for r in state.next_state(current, old, "fe").collect()}
    assert rows["a"].silver_chunks == "silver/fe/0a/chunks" and rows["a"].silver_candidates == "k" and rows["b"].silver_candidates is None and rows["c"].silver_chunks is None
    assert {r.silver_candidates for r in state.next_state(current, old, "fe", "ab").collect()} == {"silver/ab/0a/candidates", "silver/ab/0b/candidates", None}
    state.publish(state.manifest(state.next_state(current, old, "fe")), root, 1)
    assert state.published(spark, root).count() == 3
    work, _ = ingest.staged(current, spark.createDataFrame([("fe", "0a")], "fp string, hash string"), old, "fe")
    assert {r.doc_id: r.work for r in work.collect()} == {"a": "cached", "b": "embed", "c": "embed"}
    pieces = spark.createDataFrame([("0a", 0, "t")], "hash string, ordinal int, text string")
    assert ingest.cached_chunks(spark.createDataFrame([("x/moved", "0a")], "doc_id string, hash string"), pieces).first().chunk_id == "x/moved#0"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, kind string, key long, title string, owner long, authors array<long>")


def test_a_delta_equals_a_rebuild(spark):
    before = docs_of(spark, [("c/sig", "sig", 1, "One", None, []), ("c/p5", "person", 5, "Five", 1, []), ("e/k1", "kep", 1, "K1", 1, [5, 6]), ("e/k2", "kep", 2, "K2", 2, [7]), ("e/k3", "kep", 3, "K3", 1, [5])])
    after = docs_of(spark, [("c/sig", "sig", 1, "One", None, []), ("c/p5", "person", 5, "Five", 1, []), ("e/k1", "kep", 1, "K1 revised", 1, [5]), ("e/k3-moved", "kep", 3, "K3", 1, [5]), ("e/k9", "kep", 9, "K9", 3, [])])
    was, now = ledger.hashed(before), ledger.hashed(after)
    change = ingest.Delta(was.select("doc_id", "hash"), now.select("doc_id", "hash"))
    assert {(r.action, r.doc_id) for r in change.classified.collect()} == {("changed", "e/k1"), ("deleted", "e/k2"), ("added", "e/k9"), ("moved", "e/k3")}
    nodes, edges, node_plan, edge_plan = ingest.incremental(ledger.extract(was), now, change, ledger.extract)
    labels = spark.createDataFrame([("kep-1", "restricted")], "id string, tier string")
    rebuilt = ingest.full(after, ledger.extract, labels)
    got = ingest.labelled(ingest.merged(nodes, ["id"]), ingest.merged(edges, ["src", "kind", "dst"]), labels)
    for a, b in zip(got, rebuilt, strict=True):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    plan = {r.id: r.action for r in node_plan.collect()}
    assert {k for k, v in plan.items() if v == "delete"} == {"kep-2", "person:supplier6", "person:supplier7", "sig:sig-nation-2"} and plan["kep-1"] == "upsert"
    gone = {(r.src, r.dst) for r in edge_plan.where("action = 'delete'").collect()}
    assert gone == set()  # edges of deleted nodes go with them
    assert {r.tier for r in rebuilt[1].where("dst = 'kep-1'").collect()} == {"restricted"}
    assert {(r.action, r.doc_id) for r in ingest.Delta(None, now.select("doc_id", "hash")).classified.collect()} == {("added", r.doc_id) for r in after.collect()}
    clash = ledger.extract(after)[0].select("id", F.concat("kind", F.when(F.col("doc") == "e/k1", "x").otherwise("")).alias("kind"), "doc", "props")
    with pytest.raises(Exception, match="kinds clash"):
        ingest.merged(clash.where("id like 'sig%'"), ["id"]).collect()


def test_orphans_and_replacement(spark):
    store = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d1"), ("c", "d3")], "id string, doc string")
    plan = delta.reconcile(store, spark.createDataFrame([("c", "d3"), ("e", "d9")], "id string, doc string"), spark.createDataFrame([("d1",)], "doc string"), ["id"])
    assert {(r.id, r.action, tuple(r.docs)) for r in plan.collect()} == {("a", "upsert", ("d2",)), ("b", "delete", ()), ("e", "upsert", ("d9",))}
    rows = spark.createDataFrame([("s1", "p"), ("s2", "p")], "source string, doc_path string")
    assert [r.source for r in ingest.deleted(rows, spark.createDataFrame([("s1", "p")], "source string, doc_path string")).collect()] == ["s2"]
    with pytest.raises(Exception, match="no body for x"):
        ingest.parents(spark.createDataFrame([("x#1", "h", "t", "public")], "chunk_id string, heading string, text string, tier string"), spark.createDataFrame([("y", "b")], "parent_id string, body string")).collect()


def test_communities_of_two_triangles(spark):
    edges = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "ghost")]
    nodes = spark.createDataFrame([(x,) for x in ("a1", "a2", "a3", "b1", "b2", "b3", "lone")], "id string")
    rows = community.numbered(community.louvain(nodes, spark.createDataFrame(edges, "src string, dst string"))).collect()
    found = {r.id: r.community for r in rows}
    assert len(rows) == 7 and found["a1"] == found["a2"] == found["a3"] == "community-0" and found["b1"] == found["b2"] == found["b3"] == "community-1" and found["lone"] == "community-2"


def test_sizes_of_subgraphs_count_hubs_once_and_equal_the_walk(spark):
    import random

    rng = random.Random(4)
    node = lambda: f"urn:n:{min(rng.randrange(40), rng.randrange(40), rng.randrange(40))}"
    rows = [("g", node(), rng.choice("pq"), node(), "iri") for _ in range(90)] + [("g", node(), "name", f"urn:{rng.randrange(9)}", "string") for _ in range(40)] + [("g", "urn:n:0", "p", "urn:n:0", "iri")]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string, o_type string")
    roots = spark.createDataFrame([(i, f"urn:n:{i}") for i in range(0, 44)], "qid int, uri string")
    edges = {}
    for r in documents.subgraph(roots, quads.select("g", "s", "p", "o", "o_type"))[1].collect():
        edges.setdefault(r.qid, set()).add((r.subject, r.predicate, r.object))
    uri = {(s, p, o): t == "iri" for _, s, p, o, t in rows}
    expected = {(q, len(e), len({o for s, p, o in e if uri[s, p, o]}), len({o for s, p, o in e if not uri[s, p, o]}), len({s for s, _, _ in e})) for q, e in edges.items()}
    assert {tuple(r) for r in documents.subgraph_sizes(roots, quads, hub=6).collect()} == expected
