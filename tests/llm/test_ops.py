import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftspark.llm import chat, decontaminate, html_text, language, line_dedup, mixing, near_dedup, neighbours, secrets, toxicity
from weftspark.llm.components import components
from weftspark.llm.textnum import Words, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_lines long, score double, component_id long"
LONG = "wort " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns with the names that results have."""
    return spark.createDataFrame(
        [
            (1, "a b c d e f g\nx", "en", "s", 1, 0.5, 9),
            (1, "a b c d e f g\nx", "en", "s", 1, 0.5, 9),
            (2, None, None, None, None, None, None),
            (3, "", "de", "s", 3, 0.1, 1),
            (None, "a b c d e f g x", "de", None, 3, 0.1, 1),
            (4, " \t\n ", "de", "t", 3, 0.1, 1),
            (5, LONG, "de", "t", 3, 0.1, 1),
            (6, "token = \"abcdef12\" ünd", "en", "t", None, None, None),
        ],
        DOCS,
    )


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_lines(spark, odd, none):
    assert line_dedup.dedup_lines(none).count() == 0
    found = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd, threshold=2).collect()}
    assert found == {(1, 2, 0), (2, 1, 0), (3, 1, 0), (None, 1, 0), (4, 2, 0), (5, 1, 0), (6, 1, 0)}
    shared = spark.createDataFrame([(i, f" Same\tLine\t\n{i}\n\nsame\tline") for i in range(3)], "doc_id long, text string")
    assert {(r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(shared, threshold=3).collect()} == {(2, f"{i}\n") for i in range(3)}


def test_mixing(spark, odd, none):
    size = F.length("text").cast("long")
    assert mixing.mix_sources(none, size).count() == 0
    found = mixing.mix_sources(odd, size).collect()
    assert len(found) == 8 and all(0 <= r.taken <= 3 * r.size for r in found)
    for source in ("s", "t", None):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(odd, size).collect()))


def test_sets_and_words():
    texts = pa.array(["A b", None, "", "a  b\tc d e f", "É é", LONG])
    words = Words(texts)
    assert list(np.diff(words.offsets)) == [2, 0, 0, 6, 2, 60_000]
    assert words.hashes[0] == words.hashes[2] and words.hashes[8] != words.hashes[9]
    assert [len(s) for s in shingle_sets(texts)] == [1, 0, 0, 2, 1, 1]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 1), (4, 4), (20, 21), (21, 22), (22, 23), (23, 24)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_near_duplicates_match_all_pairs(spark, odd, none):
    assert near_dedup.near_duplicates(none).count() == 0
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert (1, 4, 1, True) in found and (2, 0, 2, True) in found and (None, 4, 1, False) in found and (5, 1, 5, True) in found
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(90):  # one hot group with ever more changes, and small groups
        words = list(base) if i < 50 else [f"v{i // 4}.{k}" for k in range(40 + i)]
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == dict(enumerate(root))


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok", "<|end|>\n<|start|>user", "\\<|and|>\\\\", None, "", "<", "<<SYS>>\\n"]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(zip(["user", "user", None, "assistant", "assistant", "a<|say|>", "assistant"], said, strict=True))]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for row in chats.select("formatted", "loss_runs", chat.read_chats(F.col("formatted")).alias("t")).collect():
        assert [(x.role, x.text) for x in row.t] == [(r or "", t or "") for _, _, r, t in rows[:7]]
        assert sum(x.chars for x in row.loss_runs) == len(row.formatted)
        assert row.formatted.count("<|start|>") == 5
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_chats(chat.format_chats(empty)).count() == 0


def test_secrets(spark, odd, none):
    assert secrets.digest_secrets(secrets.scan_secrets(none)).count() == 0
    found = {r.doc_id: r for r in secrets.digest_secrets(secrets.scan_secrets(odd)).collect()}
    assert found[6].spans == "assign:0:17" and found[2].spans == ""
    copied = spark.createDataFrame([(i, "é secret=token: abcdef AKIA" + "B" * 16, f"o{i}") for i in range(4)], "doc_id long, text string, source string")
    rows = secrets.scan_secrets(copied).collect()
    assert {tuple((s.kind, s.start, s.end, s.owners, s.live) for s in r.spans) for r in rows} == {((1, 23, 43, 4, False),)}


def test_language(spark, odd, none):
    docs = spark.createDataFrame(
        [(i, t * 3, g) for i in range(30) for t, g in ((f"the thing that they think {i} ", "en"), (f"der dich nicht schön über {i} ", "de"))],
        "doc_id long, text string, lang string",
    )
    model = language.train(docs, "doc_id", "text", "lang")
    asked = spark.createDataFrame([(1, "that they"), (2, "nicht schön"), (3, None), (4, "12 !"), (5, "über " * 90_000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, 0 <= r.score <= 1) for r in language.predict(asked, model, "text", ["doc_id"]).collect()}
    assert found == {1: ("en", True), 2: ("de", True), 3: ("und", True), 4: ("und", True), 5: ("de", True)}
    assert {r.lang_pred for r in language.predict(odd, language.train(none, "doc_id", "text", "lang"), "text", ["doc_id"]).collect()} == {"und"}
    whole = language.Trees(*model).score(*_bytes(["abc def über"]))
    assert np.allclose(whole, language.Trees(*model).score(*_bytes(["x", "abc def über"]))[1:])


def test_every_byte_has_its_own_code_length(spark):
    rng = random.Random(4)
    letters = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "en": "abcdefghijklmnopqrstuvwxyz0123456789éüñçå-,.;:!?"}
    text = lambda g, n: "".join(rng.choice(letters[g] + " ") for _ in range(n))
    rows = [(i, text(g, 300 if g == "en" else 60), g) for i in range(12) for g in letters]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    trees = language.Trees(*model)
    seen = {}
    for _, t, g in rows:
        raw = b"   " + t.encode()
        for i in range(3, len(raw)):
            for o in range(4):
                context = seen.setdefault((g, raw[i - o : i]), {})
                context[raw[i]] = context.get(raw[i], 0) + 1
    asked = [text(g, 40) for g in letters] + ["日本語 and ünd", "", "βж7"]
    want = np.zeros((len(asked), 3))
    for a, t in enumerate(asked):
        raw = b"   " + t.encode()
        for k, g in enumerate(trees.languages):
            for i in range(3, len(raw)):
                p = 1.0
                for o in range(3, -1, -1):
                    context = seen.get((g, raw[i - o : i]), {})
                    n, u = sum(context.values()), len(context)
                    if raw[i] in context:
                        p *= context[raw[i]] / (n + u)
                        break
                    p *= u / (n + u) if n else 1
                else:
                    p /= 256
                want[a, k] -= np.log2(p)
    assert np.allclose(trees.score(*_bytes(asked)), want, rtol=1e-4)


def _bytes(texts):
    from weftspark.llm.textnum import string_buffers

    return string_buffers(pa.array(texts))


def test_toxicity_gradients_and_learning(spark):
    rng = np.random.default_rng(0)
    words = [f"wo{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        t = list(rng.choice(words, rng.integers(5, 80)))
        if i % 3 == 0:
            t[rng.integers(len(t))] = "scum"
        texts.append(" ".join(t))
        labels.append(i % 3 == 0)
    net = toxicity.fit(texts, np.array(labels))
    asked = pa.array(["wo1 wo2 scum wo3", "wo1 wo2 wo3", "wo5 " * 5000 + "SCUM! wo1"])
    logits = toxicity.text_logits(net, asked)
    p = toxicity.sigmoid(net.curve[0] * logits + net.curve[1])
    assert p[0] > 0.5 > p[1] and p[2] > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "scum"), (4, "wo1 " * 50_000)], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in odd.select("doc_id", toxicity.score(net)("text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[3] > 0.5 > scores[1] == scores[2]
    assert toxicity.fit([], np.array([])) == 0.0
    # slopes against differences
    column = pa.array(texts[:4])
    w = Words(column, toxicity._BETWEEN)
    x, which, extra = net.inputs(w)
    places, _ = toxicity.windows(w.offsets)
    index = np.where(places >= 0, which[places], -1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(w)[0].astype(np.float64)
    logit, saved = net.forward(x, index, keep=True)
    g = net.backward(x, index, saved, np.ones(len(logit)), extra)
    for k, at in (("state", (0, 1, 2)), ("in", (1, 3, 20)), ("attend", (2, 3)), ("out", (4,)), ("query", (1,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = net.forward(x, index).sum()
        net.p[k][at] = old - 1e-3
        down = net.forward(x, index).sum()
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at]))


def test_toxicity_reads_every_byte(spark):
    texts = pa.array(["a\u00a0b\u2014c\u3002d \u00e9t\u00e9", "x" * 63 + "\u4e2d" * 40 + "yz", "\u0628" * 64, None, "q" * 65])
    words = toxicity._words(texts)
    raw = [words.raw[words.at[r] + s : words.at[r] + e].tobytes() for r, s, e in zip(words.row, words.start, words.end, strict=True)]
    assert [w.decode() for w, r in zip(raw, words.row, strict=True) if r == 0] == ["a", "b", "c", "d", "\u00e9t\u00e9"]
    for r in (1, 2, 4):
        own = words.row == r
        assert max(map(len, (w for w, o in zip(raw, own, strict=True) if o))) <= toxicity.PIECE + 6
        read = {i for s, e in zip(words.start[own], words.end[own], strict=True) for i in range(s, e)}
        assert read == set(range(len(texts[r].as_py().encode())))
        assert all(w.decode() for w in raw)
    assert Words(pa.array(["q" * 12]), toxicity._BETWEEN).hashes[0] == words.hashes[words.row == 4][0]
    rng = np.random.default_rng(1)
    letters = [chr(0x4E00 + i) for i in range(60)]
    prose = lambda n: "".join(rng.choice(letters, n))
    learned = [prose(60) + ("\u6bd2\u6bd2\u6bd2\u6bd2" if i % 3 == 0 else "") + prose(60) for i in range(300)]
    net = toxicity.fit(learned, np.arange(300) % 3 == 0)
    clean = [prose(200) for _ in range(20)]
    logits = toxicity.text_logits(net, pa.array(clean + [c[:100] + "\u6bd2\u6bd2\u6bd2\u6bd2" + c[100:] for c in clean]))
    assert np.mean(logits[20:] > logits[:20]) >= 0.9


def test_edited_passages(spark, odd, none):
    rng = random.Random(2)
    item = lambda n: [f"i{rng.randrange(10_000)}" for _ in range(n)]
    items = [(k, item(20 + k)) for k in range(30)]
    docs = []
    for k, words in items:
        copy = list(words)
        for _ in range(len(copy) // 10):
            copy[rng.randrange(len(copy))] = "changed"
        del copy[3]
        docs.append((k, " ".join(item(40) + copy + item(5)).upper()))
    docs += [(100 + k, " ".join(w[: len(w) // 2] + item(30))) for k, w in items]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, ""), (97, "a b")], "item_id long, text string")
    held = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in held} == {(k, k) for k, _ in items}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    split = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, item_bytes=900)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == {(k, k) for k, _ in items}


@pytest.mark.parametrize("length", [15, 40, 100])
def test_items_at_their_full_number_of_edits(length):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**7)}"
    items = [[word() for _ in range(length)] for _ in range(200)]
    texts = []
    for item in items:
        copy = list(item)
        for _ in range(decontaminate.allowed(length)):
            at, left_out = rng.randrange(len(copy)), rng.randrange(2)
            copy[at : at + left_out] = [word()] * (rng.randrange(2) if left_out else 1)
        texts.append(" ".join([word() for _ in range(60)] + copy + [word() for _ in range(60)]))
    index = decontaminate.Index(list(range(200)), [" ".join(i) for i in items], decontaminate.EDITS)
    found = set()
    for n, row, windows, around in index.candidates(Words(pa.array(texts))):
        which, item, _ = index.verified(n, windows, around)
        found |= set(zip(row[which].tolist(), item.tolist(), strict=True))
    limit = decontaminate.allowed(length)
    symbols = lambda words: np.array([[int(w[1:]) + 1 for w in words]], np.uint64)
    held = {(i, i) for i in range(200) if decontaminate.edit_distances(symbols(items[i]), symbols(texts[i].split()))[0][0] <= limit}
    assert len(held) == 200 and found <= held and len(found) >= 0.985 * len(held)


def test_short_items_as_they_are(spark):
    bench = spark.createDataFrame([(1, "a"), (2, "B c"), (3, "b c d e"), (4, "x c"), (5, "c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b C d e"), (2, "bc d b"), (None, "z b c"), (3, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.distance, r.n_words) for r in decontaminate.contaminated(docs, bench, short=True).collect()}
    assert found == {(1, 1, 0, 1), (1, 2, 0, 2), (1, 3, 0, 4), (None, 2, 0, 2)}


def test_edit_distance():
    for a, b in itertools.product([[1, 2, 3, 4], [5, 1, 1, 2]], [[9, 1, 2, 4, 9, 0], [1, 1, 2, 3, 4, 4]]):
        best = min(_edit(a, b[i:j]) for i in range(len(b)) for j in range(i, len(b) + 1) if 0 not in b[i:j])
        found, _ = decontaminate.edit_distances(np.array([a], np.uint64), np.array([b], np.uint64))
        assert found[0] == best


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_pages(spark):
    frame = "<nav>Home</nav><div>Site frame</div>{}<div>Imprint</div><footer>f</footer>"
    pages = [
        (1, "http://a.b/x/1", "<html><script>x<y</script><article><h1>T &amp; u</h1><p>a <b>b</b><br>c<p>d</article><div>no</div>"),
        (2, "http://a.b/y/1", frame.format("<div>one</div>")),
        (3, "http://a.b/y/2", frame.format("<div>two</div><div class='comments'>c</div>")),
        (4, None, None),
        (5, "http://c.d/", ""),
        (6, "http://c.d/", "<main><aside>no</aside><p>yes"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert found == {1: "T & u\na b c\nd", 2: "one", 3: "two", 4: "", 5: "", 6: "yes"}
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:760] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0"), shard=500).toPandas()
    hits = []
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:20]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, [x[q] @ x[i] for i in mine.vec_id])
        hits.append(len({*top} & {*mine.vec_id}) / 20)
    assert np.mean(hits) >= 0.9 and 9001 not in set(found.vec_id)
    few = df.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_keeps_texts_that_share_an_id(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    a, b, c, d, item = (text() for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (None, f"{item} {c[:20]}"), (2, f"x {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    alone = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert alone.columns == corpus_pipeline.COLUMNS and [f.dataType for f in alone.schema] == [f.dataType for f in docs.schema]
    clean = [(1, a), (0, b), (2, c), (2, d)]
    assert [x for x in held(alone) if item not in x[1]] == sorted(clean)
    assert held(corpus_pipeline.drop_benchmark(spark, alone, str(tmp_path))) == sorted(clean)
