import pytest
from pyspark.sql import functions as F

from weftspark.operators import documents, grounding, ingest, state, telemetry, vectors
from weftspark.operators.store import Store
from weftspark.sources import files


def test_quads_from_text(spark, tmp_path):
    (tmp_path / "a.nq").write_text(
        '# a comment\n\n<urn:s> <urn:p> <urn:o> <urn:g> .\n<urn:s> <urn:q> "a \\"b\\"\\n\\\\c"@en .\n_:b1 <urn:q> "2024-01-01"^^<urn:date> <urn:g> .\n', encoding="utf-8"
    )
    rows = sorted(map(tuple, files.quads(spark, str(tmp_path / "a.nq")).collect()), key=str)
    assert rows == sorted([
        ("urn:g", "urn:s", "urn:p", "urn:o", "iri", None, None), ("default", "urn:s", "urn:q", 'a "b"\n\\c', "literal", "string", "en"), ("urn:g", "_:b1", "urn:q", "2024-01-01", "literal", "urn:date", None),
    ], key=str)
    assert {r.g for r in files.quads(spark, str(tmp_path / "a.nq"), "urn:own").collect()} == {"urn:own"}
    for bad in ("", "urn:a>b", "urn:a b"):
        with pytest.raises(ValueError, match="no graph URI"):
            files.quads(spark, str(tmp_path / "a.nq"), bad)
    (tmp_path / "b.nq").write_text("nonsense\n")
    with pytest.raises(Exception, match="no quad: nonsense"):
        files.quads(spark, str(tmp_path / "b.nq")).collect()


def test_listing(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.md").write_bytes(b"\xffok")
    found = files.listing(spark, str(tmp_path), "in").collect()
    assert [(r.path, bytes(r.content)) for r in found] == [("in/deep/x.md", b"\xffok")]
    with pytest.raises(ValueError, match="leaves its folder"):
        files.listing(spark, str(tmp_path), "in/../..")


def test_written_tables(spark, tmp_path):
    root = str(tmp_path)
    outcomes = spark.createDataFrame([("urn:d", "c1", "loaded")], "s string, sha string, outcome string")
    quads = spark.createDataFrame([("n", "urn:d", "type", "Policy", "iri")], "g string, s string, p string, o string, o_type string")
    documents.write_artifacts(f"{root}/run", outcomes, quads, spark.createDataFrame([("urn:d", 0, "t")], "s string, ordinal int, text string"))
    run = Store(spark, f"{root}/run", documents.ARTIFACTS)
    assert [run.read(name).first().sha for name in documents.ARTIFACTS] == ["c1"] * 3 and run.pointer()[0] == 1
    members, summaries = spark.createDataFrame([("a", "community-1")], "id string, community string"), spark.createDataFrame([("community-1", "t")], "community string, title string")
    ingest.write_communities(summaries, members, f"{root}/groups")
    ingest.write_communities(summaries.limit(0), members.limit(0), f"{root}/groups", refresh=False)
    groups = Store(spark, f"{root}/groups", {"members": ["id"], "communities": ["community"]})
    assert groups.count("members") == 1 and groups.pointer() == (1, {"members": [1], "communities": [1]})
    chunks = spark.createDataFrame([("s/p#1", "h1", "b", "public", [1.0]), ("s/p#0", "h0", "a", "internal", [2.0])], "chunk_id string, heading string, text string, tier string, v array<double>")
    ingest.dual_write(chunks, spark.createDataFrame([("s/p", "ab")], "parent_id string, body string"), f"{root}/flat", f"{root}/tree")
    row = spark.read.parquet(f"{root}/tree").first()
    assert spark.read.parquet(f"{root}/flat").count() == 2 and (row.heading, row.tier, row.body, [c.chunk_id for c in row.children]) == ("h0", "internal", "ab", ["s/p#0", "s/p#1"])
    classes, loaded = documents.ontology(spark, "2024-01-01T00:00:00Z")
    assert documents.unshaped(classes, documents.shapes(spark)).count() == 0 and loaded.count() == 2
    assert [r.line for r in state.manifest_json(spark.createDataFrame([("a", "h")], "doc_id string, hash string")).collect()] == ['{"doc_id":"a","hash":"h"}']


def test_fingerprints_and_embedding(spark):
    one = vectors.fingerprint("embedder", dims=256, model="hash")
    assert one == vectors.fingerprint("embedder", model="hash", dims=256, description="words") != vectors.fingerprint("embedder", dims=128, model="hash") and len(one) == 16
    texts = spark.createDataFrame([(1, "One two  two THREE"), (2, ""), (3, None)], "id int, text string")
    dense = {r.id: r.v for r in vectors.embedded(texts, ["id"]).collect()}
    sparse = {(r.id, r.idx): r.value for r in vectors.unit(vectors.hash_embed(texts)).collect()}
    assert {(i, k): x for i, v in dense.items() for k, x in enumerate(v) if x} == pytest.approx(sparse) and not any(dense[2]) and not any(dense[3])
    a, b = [1.0, 0.0, 5.0], [2.0]
    got = spark.createDataFrame([(a, b, [0.0])], "a array<double>, b array<double>, z array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("s"), vectors.cosine(F.col("a"), F.col("z")).alias("t")).first()
    assert got.s == pytest.approx(2 / (26**0.5 * 2)) and got.t == 0.0


def test_spans_and_replies(spark):
    attrs = {"question.text": "q", "tool.name": "ask", "db.statement": "x"}
    spans = spark.createDataFrame([(attrs, [("exception", {"exception.message": "m", "exception.type": "E"})])], "attributes map<string,string>, events array<struct<name:string,attributes:map<string,string>>>")
    row = telemetry.redact(spans).first()
    assert row.attributes == {"tool.name": "ask"} and row.events[0].attributes == {"exception.type": "E"}
    replies = spark.createDataFrame([(1, 'x {"a": ["b", "c"], "d": "e"} y'), (2, "{broken"), (3, None)], "rid int, reply string")
    assert {(r.rid, r.field, r.value) for r in grounding.reply_filters(replies).collect()} == {(1, "a", "b"), (1, "a", "c"), (1, "d", "e")}
