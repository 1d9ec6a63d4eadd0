"""Texts and groups that once took quadratic time or unbounded memory."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import decontaminate, html_text, line_dedup
from weftspark.llm.textnum import Words


@pytest.mark.parametrize(
    "piece", ["<a ", "<a '", '<a "', '<a "">', "<![CDATA[", "<!", "<!--", "</", "<div>", "<b class=ad>", "</p>", "&", "<script>", "<p a", "<svg", "</script   "]
)
def test_broken_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.blocks(page)
    html_text.blocks(page + '">')
    html_text.blocks("<div " + "a" * 1_000_000 + ">x")
    assert time.process_time() - began < 10


def test_tags_as_before():
    page = "<P CLASS='a>b'>one<br/>two</p><!-- <p> --><![CDATA[x<y]]><script>if (a<b) '</p>'</script ><i>x</i> 1 < 2 <3 <a href=\"q>\">l</a><p unclosed 'x"
    found = [(name, closes, attributes) for _, _, name, closes, attributes in html_text.tokens(page)]
    assert found == [
        ("p", False, " CLASS='a>b'"), ("br", False, "/"), ("p", True, ""), ("", False, ""), ("", False, ""), ("", False, ""), ("i", False, ""), ("i", True, ""),
        ("a", False, ' href="q>"'), ("a", True, ""),
    ]


def test_marks_on_running_text_drop_nothing():
    page = "<main><p class='search-term'>Real paragraph</p><h2 id='menu'>Menu of the day</h2><div class='menu'>Home</div></main>"
    assert html_text.blocks(page)[0] == ["Real paragraph", "Menu of the day"]


def test_lines_of_long_equal_documents(spark):
    text = "\n".join(f"line {i}" for i in range(100_000)) + "\n\n  LINE 7 "
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit("\nown "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    found = line_dedup.dedup_lines(docs.unionByName(spark.createDataFrame([(77, "a\nline 5\nb")], "doc_id long, text string"))).collect()
    assert time.time() - began < 60
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found} == {(i, 100_003, 100_001, f"\nown {i}") for i in range(10)} | {(77, 3, 1, "a\nb")}


def test_null_ids_of_lines(spark):
    docs = spark.createDataFrame([(None, f"same\n{i}") for i in range(5)] + [(None, "same\n0"), (1, "same\n1")], "doc_id long, text string")
    found = sorted((r.kept_text, r.n_dropped) for r in line_dedup.dedup_lines(docs, threshold=2).collect())
    assert found == [("0", 1), ("0", 1), ("", 2), ("", 2), ("2", 1), ("3", 1), ("4", 1)] or found == sorted([("0", 1), ("0", 1), ("", 2), ("", 2), ("2", 1), ("3", 1), ("4", 1)])


def _alike(count, shared=20, own=10, seed=4):
    rng = random.Random(seed)
    begin = [f"s{i}" for i in range(shared)]
    return [" ".join(begin + [f"w{rng.randrange(10**6)}" for _ in range(own)]) for _ in range(count)]


def test_items_that_begin_alike_in_bounded_memory():
    items = _alike(10_000)
    index = decontaminate.Index(list(range(len(items))), items, decontaminate.EDITS)
    words = Words(pa.array([f"x y {items[i * 7]} z" for i in range(25)]))
    tracemalloc.start()
    found = set()
    for length, row, windows, around in index.candidates(words):
        which, item, distance = index.verified(length, windows, around)
        found |= {(int(r), int(i)) for r, i, d in zip(row[which], item, distance, strict=True) if d == 0}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(i, i * 7) for i in range(25)} and peak < 400e6


def test_pieces_change_no_result(monkeypatch):
    items = _alike(40, own=12)
    rng = random.Random(9)
    texts = []
    for i in range(60):
        w = items[i % 40].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(["pre"] * rng.randrange(9) + w + ["post"] * rng.randrange(9)))

    def all_found():
        index, words = decontaminate.Index(list(range(40)), items, decontaminate.EDITS), Words(pa.array(texts))
        out = []
        for length, row, windows, around in index.candidates(words):
            which, item, distance = index.verified(length, windows, around)
            out += zip(row[which].tolist(), item.tolist(), distance.tolist(), strict=True)
        return sorted(set(out))

    whole = all_found()
    monkeypatch.setattr(decontaminate, "PAIRS", 37)
    monkeypatch.setattr(decontaminate, "CELLS", 500)
    assert all_found() == whole and len({r for r, *_ in whole}) == 60
    assert list(decontaminate._pieces(np.array([5, 5, 50, 1, 1]), np.array([0, 0, 1, 2, 3]), 12)) == [(0, 2), (2, 3), (3, 5)]


def test_neighbours_of_several_dimensions(spark):
    from weftspark.llm import neighbours

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4 if i % 5 else 3).round(3).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 7"), k=5, shard=60).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, own in found.items():
        near = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))[:5]
        assert [r for r, *_ in sorted(own)] == [1, 2, 3, 4, 5] and all(len(rows[i][1]) == len(rows[q][1]) for _, i, _ in own)
        hits += len({i for _, i in near} & {i for _, i, _ in own})
    assert set(found) == {*range(0, 300, 20), 7} and hits >= 0.95 * 5 * len(found)


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    from weftspark.llm import toxicity

    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(["tree", "house", "river", "stone", "cloud", "light"]) for _ in range(n))
    rows = [(i, plain(4000) + (" you vile rotten scum " if i % 2 else " ") + plain(20), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), "doc_id", "text", "toxic", chars=1 << 20)
    asked = spark.createDataFrame([(1, plain(3000) + " vile rotten scum"), (2, plain(3000))], "doc_id long, text string")
    found = {r.doc_id: r.s for r in asked.select("doc_id", toxicity.score(model)("text").alias("s")).collect()}
    assert found[1] > 0.5 > found[2]


def test_unfinished_components_are_an_error(spark):
    from weftspark.llm.components import components

    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError, match="not finished"):
        components(chain, rounds=2)
