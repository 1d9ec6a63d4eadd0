"""Exact duplicates, periodic runs and fill-in-middle documents against plain versions of their rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import exact_dedup, infill, periodic, queries

DOCS = "doc_id long, text string, n long, row long, digest string, form string"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, columns with the names that results have."""
    rows = [
        (1, "a b", 1, 1, "x", "y"), (1, "a b", 1, 1, "x", "y"), (7, "a b", None, None, None, None), (2, None, 1, 1, None, "psm"), (3, "", 1, 1, "x", "y"),
        (None, "a b", 1, 1, "x", "y"), (None, "null id", 1, 1, "x", "y"), (None, "null id", 1, 1, "x", "y"), (4, " \t\n ", 1, 1, "x", "y"),
        (5, "wort " * 60_000, 1, 1, "x", "y"), (6, "ü€𝄞 <S> x", 1, 1, "x", "y"), (8, "Ab ab", 1, 1, "x", "y"), (9, "𝄞é\n" * 9000, 1, 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# exact duplicates


def test_equal_texts(spark, odd, tmp_path):
    for parts in (1, 2, 3):
        found = exact_dedup.exact_duplicates(odd, f"{tmp_path}/{parts}", parts=parts, buckets=4).collect()
        assert len(found) == 13 and {r.text_sha256 for r in found} == {sha(r.text) for r in odd.collect()}
        of = {}
        for r in found:
            of.setdefault(r.text_sha256, []).append(r)
        assert all(sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)} for own in of.values())
        assert {r.keep_id for r in of[sha("a b")]} == {7} and {r.keep_id for r in of[sha("")]} == {3} and {r.keep_id for r in of[sha("null id")]} == {None}
        assert all(r.kept == (r.doc_id == 7) for r in of[sha("a b")])
    none = exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_an_index_outlives_its_session_and_lost_batches(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(pairs, "doc_id long, text string")
    at = f"{tmp_path}/ix"
    first = exact_dedup.DigestIndex(spark, at, buckets=3)
    first.add(rows((1, "a"), (2, "a"), (3, "b")), "one")
    spark.sql(f"DROP TABLE {first.name}")  # a new session knows only the files
    again = exact_dedup.DigestIndex(spark, at, buckets=99)
    assert again.buckets == 3 and again.known().count() == 2
    again.add(rows((9, "a"), (8, "c"), (7, "c")), "two")
    for _ in range(2):
        assert {tuple(r)[:4] for r in again.decided("two").collect()} == {(9, 2, 3, False), (8, 8, 2, True), (7, 8, 2, False)}
        again.add(rows((9, "a"), (8, "c"), (7, "c")), "two")  # a batch that is added anew changes nothing
    assert again.known().count() == 3
    # a batch that was lost between its rows and its digests
    again.seen("two").select("id", "row", "digest").write.parquet(f"{at}/seen/batch=three")
    again.add(rows((0, "never read")), "three")
    assert again.known().count() == 3 and {r.group_size for r in again.decided("one").collect()} == {4, 1}
    plan = again.seen("two").join(again.known().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_text_with_most_of_the_rows(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_duplicates(rows, f"{tmp_path}/hot", buckets=4)
    assert found.where("kept").count() == 2001
    assert [tuple(r) for r in found.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(2997, 1000)]


# periodic runs


def plain_runs(words):
    """All runs and the collapsed text, by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    out = sorted((s, e - s, q) for (s, e), q in found.items())
    gone = {i for s, length, q in out for i in range(s + q, s + length)}
    return sorted(out, key=lambda r: (r[0], r[2])), " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts(texts):
    text = periodic.Text(pa.array(texts, pa.string()))
    row, *told = periodic.runs(text)
    found = [[] for _ in texts]
    for k, *run in zip(row, *told, strict=True):
        found[k].append(tuple(map(int, run)))
    return list(zip(found, periodic.collapsed(text, row, *told).to_pylist(), strict=True))


def test_runs_against_all_periods():
    rng = random.Random(5)
    texts = [None, "", " \n", "a a a a a a", "é é é é é é x", "a a a a a", "A a A a A a A a", "a\xa0a a a a a a"]
    for _ in range(600):
        letters, words = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])], []
        while len(words) < rng.choice([5, 40, 250]):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([3, 9, 40])))]
            words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 300)] if rng.random() < 0.6 else unit[:5]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(words) + rng.choice(["", " "]))
    assert run_texts(texts) == [plain_runs(re.findall(WORD, t or "")) for t in texts]


def test_convolution_is_exact():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 64):
        block, after = rng.integers(0, 2**31, (3, size)), rng.integers(0, 2**31, (3, 2 * size - 1))
        own, there = block.astype(object), after.astype(object)
        expected = [[sum((own[r, i] - there[r, d + i]) ** 2 for i in range(size)) % int(periodic.PRIME) for d in range(size)] for r in range(3)]
        assert periodic.squared_differences(block, after).tolist() == expected


def test_long_texts_of_few_words():
    import time

    n = 100_000
    for text, expected in (
        ("a " * n, [(0, n, 1)]), ("a " * n + "x " + "a " * n, [(0, n, 1), (n + 1, n, 1)]),
        (" ".join(str(i % 7000) for i in range(n)), [(0, n, 7000)]), (" ".join(str(i % 30_000) for i in range(n)), []),
    ):
        began = time.process_time()
        assert run_texts([text])[0][0] == expected and time.process_time() - began < 20


def test_planted_runs_of_the_query(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(120))) for i in range(400)} | {400: None, 401: " ", 402: "\n\nx"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found.values()) > 10
    for i, text in texts.items():
        words, h = re.findall(WORD, text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, len(words))]
        runs, text = plain_runs(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = found[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), s, length, q, None if s is None else 1000 * length // q)
        assert r.collapsed_sha256 == sha(text) and r.runs_sha256 == sha("".join("%d,%d,%d\n" % run for run in runs))


def test_runs_of_odd_rows(spark, odd):
    found = periodic.periodic_runs(odd).collect()
    assert len(found) == 13 and {(r.doc_id, r.n_words, len(r.runs)) for r in found} >= {(2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 60_000, 1), (9, 9000, 1), (None, 2, 0)}
    assert {r.collapsed_text for r in found if r.doc_id in (2, 3, 4, 5)} == {"", "wort"}
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


# fill in middle


def plain_fim(i, text):
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_against_plain_slices(spark, odd):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é€𝄞\n<>PSM") for _ in range(rng.randrange(60)))) for i in range(3000)] + [(3000, "é€𝄞x" * 300_000)]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted((str(i), *map(str, plain_fim(i, t or "")), t or "") for i, t in rows)
    assert sorted(tuple(map(str, r)) for r in made) == expected
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(odd.limit(0)).count() == 0


def test_lines_as_units_and_marks_of_ones_own(spark):
    docs = spark.createDataFrame([(i, f"eins {i}\n\nzwei\nü{i}\n" * (i % 4)) for i in range(60)], "doc_id long, text string")
    marks = ("[PRE]", "[SUF]", "[MID]")
    made = infill.fill_in_middle(docs, unit="line", plain_rate=0, spm_rate=50, marks=marks)
    back = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).join(docs, "doc_id").collect()
    assert len(back) == 60 and all(r.back == r.text and r.n == r.text.count("\n") for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"} and all((r.form == "plain") == (not r.text) for r in back)
    cut = [r for r in back if r.form == "psm"]
    assert all(r.output.split("[SUF]")[0] == "[PRE]" + "".join(r.text.splitlines(True)[: r.prefix_units]) for r in cut)
    for bad in (("<", "<", ">"), ("<P>", "<S>", ""), ("ab", "bc", "x"), ("<P>", "<P>x", "y")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=bad)
