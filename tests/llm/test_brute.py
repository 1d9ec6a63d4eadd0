"""The operators against plain brute-force versions, and odd rows that the other tests do not have."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftspark.llm import chat, html_text, language, neighbours, queries, secrets, toxicity


def test_the_mask_alone_decides_what_bears_loss(spark):
    said = [("user", "a|<b"), ("assistant", "\\\\ <|and|> é𝄞"), ("assistant", ""), ("assistant", "<|end|>\n<|start|>x"), ("assistant", None), ("user", "z"), ("assistant", "last")]
    rows = [(c, i, r, t, "x") for c in (1, None) for i, (r, t) in enumerate(said)] + [(2, 0, "user", "only", "x"), (3, 0, "assistant", "w" * 300_000, "x")]
    rows += [(4, 1, "user", "tie b", "x"), (4, 1, "user", "tie a", "x"), (4, 1, "user", "tie a", "x"), (4, None, None, None, None)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    loss = {r.conv_id: r.loss for r in chats.select("conv_id", chat.loss_texts(F.col("formatted"), F.col("loss_runs")).alias("loss")).collect()}
    told = [t or "" for r, t in said if r == "assistant"]
    assert loss == {1: told, None: told, 2: [], 3: ["w" * 300_000], 4: []}
    good = {r.conv_id: (r.loss_chars, r.loss_sha256, r.n_turns) for r in chat.digest_chats(chats).collect()}
    assert good[1][0] == sum(map(len, told)) and good[4][2] == 4
    flip = F.transform("loss_runs", lambda x: F.struct(x["chars"].alias("chars"), (~x["loss"]).alias("loss"), x["last"].alias("last")))
    shift = F.transform("loss_runs", lambda x: F.struct((x["chars"] + 1).alias("chars"), x["loss"].alias("loss"), x["last"].alias("last")))
    for broken in (flip, shift):
        bad = {r.conv_id: (r.loss_chars, r.loss_sha256, r.n_turns) for r in chat.digest_chats(chats.withColumn("loss_runs", broken)).collect()}
        assert bad[1][:2] != good[1][:2] and bad[1][2] == good[1][2]


def test_the_network_step_by_step():
    rng = np.random.default_rng(5)
    words = [f"wo{i}" for i in range(40)] + ["Scum", "ünd", "x" * 70]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 7, 32, 33, 90, 300)]
    learned = [" ".join(rng.choice(words[:40], 20)) + (" scum" if i % 3 == 0 else "") for i in range(150)]
    net = toxicity.fit(learned, np.arange(150) % 3 == 0)
    p, h = net.p, toxicity.HIDDEN
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def vector(raw: bytes, hashed: int) -> np.ndarray:
        slot = np.flatnonzero(net.vocabulary == hashed)
        chars = [p["char"][(b + 32 if 65 <= b <= 90 else b) + 256 * min(i, toxicity.PLACES - 1)] for i, b in enumerate(raw)]
        return np.concatenate([p["word"][slot[0] if len(slot) else -1], np.mean(chars, 0)])

    def window(vectors: list) -> float:
        states = []
        for d in (0, 1):
            state, out = np.zeros(h), []
            for x in vectors if d == 0 else vectors[::-1]:
                a, u = x @ p["in"][d] + p["bias"][d], p["state"][d]
                gates = logistic(a[: 2 * h] + state @ u[:, : 2 * h])
                z, r = gates[:h], gates[h:]
                state = state + z * (np.tanh(a[2 * h :] + (r * state) @ u[:, 2 * h :]) - state)
                out.append(state)
            states.append(out if d == 0 else out[::-1])
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        weight = np.exp([np.tanh(b @ p["attend"]) @ p["query"] for b in both])
        return float((weight / weight.sum()) @ np.array(both) @ p["out"] + p["level"][0])

    for text, found in zip(texts, toxicity.text_logits(net, pa.array(texts)), strict=True):
        own = toxicity._words(pa.array([text]))
        vectors = [vector(own.raw[s:e].tobytes(), k) for s, e, k in zip(own.start, own.end, own.hashes, strict=True)]
        begins = range(0, max(1, len(vectors) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        best = max(window(vectors[b : b + toxicity.WINDOW]) for b in begins) if vectors else float(p["level"][0])
        assert abs(best - found) < 1e-3


def test_training_of_scores_on_odd_rows(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join([f"wo{rng.randrange(50)}" for _ in range(20)] + ["scum"] * bad)
    docs = [(i, text(i % 3 == 0), None) for i in range(240)] + [(0, text(1), "y"), (1, text(0), "y"), (1, text(0), "y"), (None, "scum", None), (500, None, None), (501, "", None)]
    docs += [(502, "wo1 " * 40_000, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(240)] + [(0, 0), (3, 1), (None, 1), (7, None), (8, 9), (500, 1), (501, 0), (502, 0), (9999, 1)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    again = toxicity.train(docs.repartition(5), labels, "doc_id", "text", "toxic")
    assert all((net.p[k] == again.p[k]).all() for k in net.p)
    asked = spark.createDataFrame([(1, "wo1 wo2 scum wo3 wo4"), (2, "wo1 wo2 wo3 wo4"), (3, None)], "doc_id long, text string")
    scores = [r.s for r in asked.orderBy("doc_id").select(toxicity.score(net)("text").alias("s")).collect()]
    assert scores[0] > 0.5 > scores[1] and 0 <= scores[2] <= 1
    assert toxicity.train(docs, labels.limit(0), "doc_id", "text", "toxic") == 0.0
    assert toxicity.train(docs, labels.where("toxic = 1"), "doc_id", "text", "toxic") == 1.0


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = ["Zq9" + "".join(rng.choice("abcXYZ019+/") for _ in range(22)) for _ in range(6)]
    lines = [lambda: f'API_key = "{rng.choice(mixed)}"', lambda: f"pässword:{hexes(8)}", lambda: "token=ab", lambda: f"AKIA{'Q' * rng.randrange(14, 20)}", lambda: hexes(rng.randrange(20, 40)),
             lambda: rng.choice(mixed), lambda: "é ünd 𝄞", lambda: "secret: : password='a.b-c_d' token", lambda: "x" * 30]
    rows = [(i, "\n".join(rng.choice(lines)() for _ in range(rng.randrange(12))), f"o{rng.randrange(4)}", f"r{rng.randrange(6)}") for i in range(60)]
    rows += [(100, None, "o1", "r1"), (101, "", None, None), (102, mixed[0] + " " + mixed[0], None, None), (102, mixed[0] + " " + mixed[0], None, None), (None, mixed[1], "o9", "r9"), (104, "secret=only-here-9", "o1", "r1")]
    rows += [(103, " ".join(hexes(24) for _ in range(700)), "o1", "r1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, repo string, base string")
    found = {(r.doc_id, r.text): r for r in secrets.scan_secrets(docs, repo_col="repo").join(docs.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("i").eqNullSafe(F.col("doc_id"))).collect()}

    def spans(text: str) -> list:
        out = []
        for kind, (_, words, group, least) in enumerate([*secrets.BASE, secrets.ADDED]):
            own = [(m.start(), kind, m.end(), m[group]) for m in re.finditer(words, text) if len(m[group]) >= least]
            if kind == len(secrets.BASE):
                own = [s for s in own if re.search("[0-9]", s[3]) and re.search("[A-Za-z]", s[3]) and not any(b[0] < s[2] and s[0] < b[2] for b in out)]
            out += own
        return out

    owners: dict = {}
    for _, text, owner, repo in rows:
        for s in spans(text or ""):
            owners.setdefault(s[3], set()).add((owner, repo))
    live = lambda v: len({o for o, _ in owners[v]}) <= secrets.FEW and len(owners[v]) <= secrets.FEW_REPOS
    kinds = set()
    for i, text, _, _ in rows:
        want = sorted((s[0], s[1], s[2], len({o for o, _ in owners[s[3]]}), len(owners[s[3]]), live(s[3])) for s in set(spans(text or "")) if s[1] < 3 or live(s[3]))
        row = found[(i, text)]
        assert sorted((s.start, s.kind, s.end, s.owners, s.repos, s.live) for s in row.spans) == want
        assert sorted((s.start, s.kind, s.end) for s in row.base) == sorted(s[:3] for s in spans(text or "") if s[1] < 3)
        kinds |= {(s[1], s[5]) for s in want}
    assert (3, True) in kinds and {(0, True), (0, False)} <= kinds


def test_common_lines_against_the_table(monkeypatch):
    rng = random.Random(1)
    for cells in (1 << 27, 4):
        monkeypatch.setattr(html_text, "CELLS", cells)
        for _ in range(400):
            k = rng.randrange(1, 6)
            a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(14))] for _ in range(2))
            table = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, j in itertools.product(range(len(a)), range(len(b))):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
            rest = html_text.unshared(a, b)
            assert len(a) - len(rest) == table[-1, -1]
            left = iter(a)
            assert all(x in left for x in rest)
    assert html_text.unshared(["x"] * 20_000 + ["q"], ["x"] * 19_990 + ["z"] + ["x"] * 5) == ["x"] * 5 + ["q"]


def test_frames_of_unmarked_pages(spark):
    frame = "<nav>Home</nav><div>Site frame</div><p>Menu of {h}</p>{}<div>Imprint</div><div>Imprint</div>"
    body = lambda n: "".join(f"<p>story {n} line {k}</p>" for k in range(5))
    pages = [(n, f"https://{h}.example/{n:03d}", frame.format(body(n), h=h), "x") for n, h in ((n, f"h{n % 3}") for n in range(60))]
    pages += [(100, pages[7][1] + "?utm=1", pages[7][2], "x"), (7, pages[7][1], pages[7][2], "x"), (None, None, frame.format(body("n"), h="n"), "x"), (101, "https://h0.example/999", "<p>" + "long " * 60_000, "x")]
    pages += [(102, "https://one.example/", frame.format(body(0), h="one"), "x")]
    found = [(r.page_id, r.text) for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()]
    story = lambda n: "\n".join(f"story {n} line {k}" for k in range(5))
    alone = lambda h, n: f"Site frame\nMenu of {h}\n{story(n)}\nImprint\nImprint"
    want = [(n, story(n)) for n in range(60)] + [(100, story(7)), (7, story(7)), (None, alone("n", "n")), (101, " ".join(["long"] * 60_000)), (102, alone("one", 0))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_language_learns_from_odd_rows(spark):
    rows = [(i, f"the thing that they think {i}", "en") for i in range(30)] + [(i, f"der dich nicht schön {i}", "de") for i in range(30, 60)]
    odd = rows + [(1, rows[1][1], "en")] * 3 + [(70, None, "en"), (71, "", "de"), (72, "no language", None), (None, "der dich und", "de")]
    same = rows + [(71, "", "de"), (None, "der dich und", "de")]
    schema = "doc_id long, text string, lang string"
    a, b = (language.train(spark.createDataFrame(r, schema), "doc_id", "text", "lang") for r in (odd, same))
    assert a[0] == b[0] == ["de", "en"]
    assert all((x == y).all() for p, q in zip(a[1], b[1], strict=True) for x, y in zip(p, q, strict=True))
    few = language.train(spark.createDataFrame(rows, schema), "doc_id", "text", "lang", sample=10)
    assert all(n.sum() <= 10 * 30 for _, n in few[1])


def test_language_learns_all_of_repeated_rows(spark):
    same = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("ein und derselbe satz").alias("text"), F.lit("de").alias("lang"))
    many = spark.range(20_000).select((F.col("id") % 500).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"), F.lit("en").alias("lang"))
    languages, counts = language.train(same.unionByName(many), "doc_id", "text", "lang")
    assert languages == ["de", "en"] and [int(n.sum()) for _, n in counts] == [21, sum(len(f"text {i}") for i in range(500))]
    # more digests than the sample: exactly the sample is learned
    languages, counts = language.train(many.withColumn("text", F.lit("gleich")), "doc_id", "text", "lang", sample=40)
    assert [int(n.sum()) for _, n in counts] == [240]


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 1.0, 2) for i in range(60)] + [(3, [9.0] * 8, 1.0, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int")
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert found[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"} and len(found) == 60
    kept = {i: min(v for j, v, *_ in rows if j == i) for i in range(60)}
    for q in (0, 20, 40):
        s = {i: float(np.dot(kept[q], v)) for i, v in kept.items() if i != q}
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == sorted(s, key=lambda i: (-s[i], i))[:20]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: toxic documents, common lines, near copies, benchmark items and odd rows."""
    at, rng = tmp_path_factory.mktemp("small"), random.Random(12)
    word = lambda: f"w{rng.randrange(900)}"
    text = lambda n=40: " ".join(word() for _ in range(n))
    item = text(20)
    rows = [(i, text() + (" scum scum" if i % 4 == 0 else "") + "\n" + text(), "en", f"s{i % 3}") for i in range(300)]
    rows[1] = (1, rows[2][1].upper(), "en", "s1")  # a copy of document 2
    rows[3] = (3, f"{text()} {item} {text()}", "en", "s0")
    rows = [(i, t + "\nAll rights reserved here" if 40 <= i < 60 else t, g, s) for i, t, g, s in rows]
    rows += [(None, None, None, None), (None, "", "en", None), (900, "", None, "s1"), (901, text(30_000), "de", None), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_each_stage_of_the_pipeline(spark, small):
    at, rows = small
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("_key", F.lit("x")).withColumn("kept", F.lit(1))
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = corpus_pipeline.drop_toxic(spark, docs, at)
    assert clean.columns == corpus_pipeline.COLUMNS
    assert got(clean) == sorted(((i, t) for i, t, *_ in rows if not (t and "scum" in t)), key=str)
    lines = corpus_pipeline.drop_common_lines(spark, docs, at)
    assert lines.columns == corpus_pipeline.COLUMNS
    assert got(lines) == sorted(((i, (t or "").removesuffix("\nAll rights reserved here")) for i, t, *_ in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    alone = corpus_pipeline.drop_near_copies(spark, docs, at)
    assert alone.columns == corpus_pipeline.COLUMNS
    assert got(alone) == sorted({(i, t) for i, t, *_ in rows if i != 2}, key=str)
    fair = corpus_pipeline.drop_benchmark(spark, docs, at)
    assert got(fair) == sorted(((i, t) for i, t, *_ in rows if i != 3), key=str)
    mixed = corpus_pipeline.mix(spark, docs, at).collect()
    assert len(mixed) == len(rows) and sum(r.taken for r in mixed) == pytest.approx(sum(len((t or "").split()) for _, t, *_ in rows), abs=8)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0


def test_the_pipeline_end_to_end(spark, small):
    at, rows = small
    found = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
    assert found == {i for i, t, *_ in rows if not (t and "scum" in t) and i not in (2, 3)}


def test_the_pipeline_goes_on_from_its_last_whole_stage(spark, small, tmp_path, monkeypatch):
    at, _ = small
    whole = sorted(map(tuple, corpus_pipeline.run(spark, at).collect()))
    ran = []

    def failing(spark, docs, sf_dir):
        raise RuntimeError("lost")

    def told(name, stage):
        return name, lambda *a: ran.append(name) or stage(*a)

    stages = [told(*s) for s in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("decontamination", failing), stages[4]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, at, str(tmp_path / "run"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at, str(tmp_path / "run")).collect())) == whole
    assert ran == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["mixing"]


def test_registered_queries_name_the_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
