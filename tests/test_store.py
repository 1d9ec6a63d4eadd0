"""Stores under one pointer, maintenance by difference, artifacts by content."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators import ingest
from weftspark.operators.store import Artifacts, Store


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_run_that_dies_between_two_tables_changes_neither(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"a": ["k"], "b": ["k"]})
    assert store.count("a") == -1
    rows = lambda *pairs: spark.createDataFrame(pairs, "k int, v string")
    one = store.commit({"a": rows((1, "x"), (2, "y")), "b": rows((1, "x"))}, whole=True)
    with pytest.raises(Exception, match="no more"):
        store.commit({"a": rows((2, "new"), (3, "z")), "b": rows((1, "w")).withColumn("v", F.raise_error(F.lit("no more")).cast("string"))})
    assert store.pointer()[0] == one and _rows(store.read("a"), "k", "v") == [(1, "x"), (2, "y")] and _rows(store.read("b"), "k", "v") == [(1, "x")]
    two = store.commit({"a": rows((2, "new"), (3, "z")), "b": rows((5, "w"))})
    assert _rows(store.read("a"), "k", "v") == [(1, "x"), (2, "new"), (3, "z")] and _rows(store.read("b"), "k", "v") == [(1, "x"), (5, "w")]
    # who holds the old version still reads it
    assert _rows(store.read("a", one), "k", "v") == [(1, "x"), (2, "y")] and two == one + 1


def test_deletes_counts_clearing_and_compaction_against_rewriting(spark, tmp_path):
    rng = random.Random(3)
    store = Store(spark, str(tmp_path / "s"), {"chunks": ["source", "doc_path"]})
    shape = "source string, doc_path string, chunk_id string, text string"
    held: dict[tuple, list] = {}
    for step in range(3):
        docs = {(rng.choice("ab"), f"p{rng.randrange(6)}") for _ in range(4)}
        fresh = {d: [(*d, f"{d[1]}#{i}", f"{step}") for i in range(rng.randrange(1, 4))] for d in docs}
        gone = [(rng.choice("ab"), f"p{rng.randrange(6)}") for _ in range(2)] if step else []
        gone = [d for d in gone if d not in fresh] + ([(None, "p0")] if step == 2 else [])
        store.commit({"chunks": spark.createDataFrame([r for rows in fresh.values() for r in rows], shape)}, {"chunks": spark.createDataFrame(gone, "source string, doc_path string")} if gone else None)
        held = {d: rows for d, rows in held.items() if d not in gone} | fresh
        expected = sorted(r for rows in held.values() for r in rows)
        assert _rows(store.read("chunks"), "source", "doc_path", "chunk_id", "text") == expected and store.count("chunks") == len(expected)
    before = store.pointer()[0]
    store.compact("chunks")
    assert _rows(store.read("chunks"), "source", "doc_path", "chunk_id", "text") == expected and len(store.pointer()[1]["chunks"]) == 1
    store.clear("chunks")
    assert store.count("chunks") == 0 and store.read("chunks").columns == ["source", "doc_path", "chunk_id", "text"]
    assert store.read("chunks", before).count() == len(expected)


def _extract(docs):
    said = docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("says", ",")).alias("w")).where("w <> ''")
    nodes = said.select(F.col("w").alias("id"), F.lit("word").alias("kind"), "doc", F.create_map(F.lit("seen"), "doc").alias("props"))
    pairs = docs.select(F.col("doc_id").alias("doc"), F.split("says", ",").alias("ws")).where(F.size("ws") > 1)
    edges = pairs.select(F.get("ws", 0).alias("src"), F.lit("NEXT").alias("kind"), F.get("ws", 1).alias("dst"), "doc", F.create_map().cast("map<string,string>").alias("props"))
    return nodes, edges


def test_deltas_one_after_another_against_rebuilds(spark, tmp_path):
    rng = random.Random(11)
    store = Store(spark, str(tmp_path / "s"), ingest.TABLES)
    corpus = {f"a/d{i}": ",".join(rng.sample("abcdefghij", rng.randrange(1, 4))) for i in range(12)}
    docs = lambda: spark.createDataFrame(list(corpus.items()), "doc_id string, says string").withColumn("hash", F.sha2("says", 256))
    ingest.ingest(store, docs(), _extract)
    for step in range(2):
        for d in rng.sample(sorted(corpus), 2):
            del corpus[d]
        for d in rng.sample(sorted(corpus), 2):
            corpus[d] = ",".join(rng.sample("abcdefghijkl", rng.randrange(1, 4)))
        corpus[f"b/new{step}"] = "z,a" if step == 1 else ""
        run = ingest.Maintained(store, docs(), _extract)
        planned = {name: _rows(run.after(name), *keys, "docs") for name, keys in ingest.KEYS.items()}
        told = {r.what: r.n for r in run.report().collect()}
        run.commit()
        nodes, edges = _extract(docs())
        for name, rows in (("nodes", nodes), ("edges", edges)):
            keys = ingest.KEYS[name]
            whole = ingest.merged(rows, keys)
            assert _rows(store.read(name), *keys, "docs", "sources") == _rows(whole, *keys, "docs", "sources")
            assert planned[name] == _rows(whole, *keys, "docs")
            assert told[f"{name}_gained"] <= whole.count()
        assert _rows(store.read("manifest"), "doc_id") == sorted((d,) for d in corpus)
    unchanged = ingest.Maintained(store, docs(), _extract)
    assert {r.what: r.n for r in unchanged.report().collect()}.get("nodes_gained") == 0


PIECE = T.StructType([T.StructField("text", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
CLAIM = T.StructType([T.StructField("said", T.StringType())])


def test_staged_runs_compute_only_what_is_missing(spark, tmp_path):
    seen = []

    def embed(docs):
        seen.extend(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        pieces = docs.select("hash", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("ordinal", "text"))
        return pieces.withColumn("v", F.array(F.length("text").cast("double")))

    def propose(docs):
        return docs.where("text like '%owns%'").select("hash", F.lit(0).alias("ordinal"), F.col("text").alias("said"))

    def ground(candidates):
        part = F.split("said", " ")
        rows = candidates.select("cid", "doc", F.get(part, 0).alias("src"), F.get(part, 2).alias("dst"))
        ok = F.col("src") != F.col("dst")
        return rows.where(ok).select("src", "dst", "doc"), rows.select("cid", F.when(ok, "accepted").otherwise("ungrounded").alias("verdict"))

    chunks, claims = Artifacts(spark, f"{tmp_path}/chunks", PIECE), Artifacts(spark, f"{tmp_path}/claims", CLAIM)
    state = "doc_id string, content_hash string, stage string, silver_chunks string, silver_candidates string"
    docs = lambda **d: spark.createDataFrame([(f"s/{k}", v) for k, v in d.items()], "doc_id string, text string").withColumn("hash", F.sha2("text", 256))

    def run(d, before, fp="aa", xfp="bb"):
        seen.clear()
        return ingest.staged_run(d, before, chunks, fp, embed, claims, xfp, propose, ground)

    none = spark.createDataFrame([], state)
    one = run(docs(a="x owns y", b="plain text", c="", d="plain text"), none)
    assert (one["embedded"], one["extracted"]) == (3, 3) and len(seen) == 3
    assert _rows(one["chunks"], "chunk_id", "text", "v") == sorted([("s/a#0", "x", [1.0]), ("s/a#1", "owns", [4.0]), ("s/a#2", "y", [1.0])] + [(f"s/{k}#{i}", w, [float(len(w))]) for k in "bd" for i, w in enumerate(("plain", "text"))])
    assert _rows(one["edges"], "src", "dst", "doc") == [("x", "y", "s/a")] and _rows(one["traces"], "cid", "verdict") == [("s/a#0", "accepted")]
    # nothing changed, one moved: nothing is computed or written
    files = lambda: sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    before = files()
    two = run(docs(a2="x owns y", b="plain text", c=""), one["state"])
    assert (two["embedded"], two["extracted"], seen) == (0, 0, []) and files() == before
    assert _rows(two["chunks"], "chunk_id")[:3] == [("s/a2#0",), ("s/a2#1",), ("s/a2#2",)] and _rows(two["edges"], "doc") == [("s/a2",)]
    assert {r.doc_id: r.stage for r in two["state"].collect()} == {"s/a2": "gold", "s/b": "gold", "s/c": "gold"}
    # another embedder: every chunk is a miss, candidates are not
    three = run(docs(a="x owns y", b="plain text"), two["state"], fp="cc")
    assert (three["embedded"], three["extracted"]) == (2, 0)
    assert len(seen) == 2 and run(docs(a="new"), none)["embedded"] == 1
    assert ingest.staged_run(docs(a="x owns y"), none, chunks, "aa", embed)["edges"] is None
