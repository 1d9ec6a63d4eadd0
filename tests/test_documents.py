from pyspark.sql import functions as F

from weftspark.functions import documents as D
from weftspark.operators import vectors
from weftspark.sources import corpus


def test_classes_come_from_front_matter_then_the_path(spark):
    rows = [
        (1, "a/b.md", "---\ntype: Policies\ntitle: T\ntitle: U\neffective_date: 2024-01-02\n---\nx"),
        (2, "ops/Meeting-notes/policy.v2.md", "no block"),
        (3, "x/.hidden", "---\ntype: memo\nscope:  all \n---"),
        (4, None, None),
        (5, "job-aids/sops/a.txt", "---\ntype: sops\n---"),
        (6, "c\\guidelines\\d", "--- \nname: N\n---\n"),
    ]
    docs = spark.createDataFrame(rows, "i int, path string, text string")
    got = docs.select("i", *[c.alias(k) for k, c in D.classify(F.col("path"), F.col("text")).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("policy", "urn:class:Policy", "normative", "U", "2024-01-02", None),
        ("transcript", "urn:class:Transcript", "descriptive", "policy.v2", None, None),
        ("sop", "urn:class:SOP", "descriptive", ".hidden", None, "all"),
        ("sop", "urn:class:SOP", "descriptive", "", None, None),
        ("sop", "urn:class:SOP", "descriptive", "a", None, None),
        ("guideline", "urn:class:Guideline", "normative", "N", None, None),
    ]


def test_markdown_and_yaml(spark):
    rows = [(1, "\n---\ntitle: A\n---\n\n# One\ntext\n  ## Two \n"), (2, "---\nno end"), (3, "---\n: [\n---\n#x"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "i int, text string").select("i", *[c.alias(k) for k, c in D.markdown(F.col("text")).items()])
    got = docs.withColumn("y", D.yaml_json("block")).orderBy("i").collect()
    assert [(r.y, r.body, r.headings) for r in got] == [
        ('{"title": "A"}', "# One\ntext\n  ## Two \n", ["# One", "## Two"]),
        (None, "---\nno end", []),
        ("{}", "#x", ["#x"]),
        (None, "", []),
        (None, None, None),
    ]


def test_claims_keep_their_sentence_and_the_cap(spark):
    text = "First. We collaborate closely with SIG Node\n and collaborated with SIG-Apps. End"
    docs = spark.createDataFrame([(1, "sig", text), (2, "kep", "It supersedes the old KEP-12. Builds on. KEP-3 depends on KEP-4 "), (3, "page", text), (4, "sig", None)], "i int, kind string, body string")
    got = {r.i: [tuple(x) for x in r.c] for r in docs.select("i", D.claims(F.col("kind"), F.col("body")).alias("c")).collect()}
    span = "We collaborate closely with SIG Node and collaborated with SIG-Apps"
    assert got[1] == [("COLLABORATES_WITH", "SIG Node", span), ("COLLABORATES_WITH", "SIG-Apps", span)]
    assert got[2] == [("SUPERSEDES", "KEP-12", "It supersedes the old KEP-12"), ("DEPENDS_ON", "KEP-4", "KEP-3 depends on KEP-4")]
    assert got[3] == [] and got[4] == []
    many = spark.createDataFrame([("sig", "collaborates with SIG X. " * 30)], "kind string, body string")
    assert many.select(F.size(D.claims(F.col("kind"), F.col("body")))).first()[0] == 20


def test_templates(spark):
    asked = ["tech lead of SIG Node?", "KEPs of sig-node", "who owns KEP-12", "what does @ann chair", "about SIG Node", "weather", None]
    got = spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", D.template(F.col("q"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["sig_tech_leads", "sig_owned_keps", "kep_owning_sig", "person_led_sigs", "sig_owned_keps", None, None]


def test_corpus_is_read_in_order_and_extracted(spark, tmp_path):
    files = {
        "c/sigs.yaml": "sigs:\n- dir: sig-node\n  name: Node\n  leadership:\n    chairs:\n    - {github: '@Ann', name: Ann A}\n    - 5\n  subprojects:\n  - name: Kube let\n- 7\n- name: none\n",
        "c/sig-node/README.md": "---\ntitle: Charter\n---\n# Node",
        "c/other/README.md": "# not listed",
        "e/keps/sig-node/0012-fast/kep.yaml": "title: Fast\nstatus: alpha\nauthors: ['@ann', Bob B]\nowning-sig: sig-node\n",
        "e/keps/sig-node/0012-fast/README.md": "# KEP-12: Fast\n**Authors:** Nobody",
        "e/keps/sig-apps/0007-old/README.md": "# Old\n\n**Authors:** `Ann A`, Cy\n",
        "e/keps/sig-apps/draft/README.md": "# Draft",
    }
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    docs = corpus.corpus(spark, str(tmp_path / "c"), str(tmp_path / "e"))
    assert [r.doc_id for r in docs.orderBy("ord").collect()] == [
        "community/sigs.yaml", "community/sig-node/README.md", "enhancements/keps/sig-apps/0007-old/README.md",
        "enhancements/keps/sig-node/0012-fast/kep.yaml", "enhancements/keps/sig-node/0012-fast/README.md",
    ]
    assert [r.dir for r in corpus.skipped(spark, str(tmp_path / "e")).collect()] == ["keps/sig-apps/draft"]
    nodes, edges = corpus.extract(docs, spark.createDataFrame([("ann a", "ann")], "alias string, handle string"))
    assert {(r.src, r.kind, r.dst) for r in edges.collect()} == {
        ("person:ann", "CHAIRS", "sig:sig-node"), ("sig:sig-node", "HAS_SUBPROJECT", "subproject:sig-node/kube-let"),
        ("sig:sig-node", "OWNS", "kep-12"), ("sig:sig-apps", "OWNS", "kep-7"), ("person:ann", "AUTHORS", "kep-12"),
        ("person:bob b", "AUTHORS", "kep-12"), ("person:ann", "AUTHORS", "kep-7"), ("person:cy", "AUTHORS", "kep-7"),
    }
    props = {}
    for r in nodes.orderBy("ord").collect():
        props[r.id] = r.props | props.get(r.id, {})
    assert props["sig:sig-node"] == {"slug": "sig-node", "name": "Node", "charter_title": "Charter"}
    assert props["kep-12"] == {"title": "Fast", "status": "alpha"} and props["kep-7"] == {"title": "Old"}
    assert props["person:ann"] == {"name": "Ann A"}


def test_filtered_questions_only_narrow(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "a", 1), (2, [0.9, 0.1], "b", 1), (3, [1.0, 0.0], "a", 3)], "chunk_id long, v array<double>, label string, r int")
    asked = spark.createDataFrame([("all", [1.0, 0.0], None, 3), ("b", [1.0, 0.0], ["b"], 3), ("low", [1.0, 0.0], ["a"], 1), ("none", [1.0, 0.0], [], 3)], "qid string, q array<double>, wanted array<string>, clearance int")
    got = sorted((r.qid, r["rank"], r.chunk_id) for r in vectors.knn(asked, chunks, 2).collect())
    assert got == [("all", 1, 1), ("all", 2, 3), ("b", 1, 2), ("low", 1, 1)]


def test_overlaps_of_whole_texts(spark):
    import random

    from weftspark.operators import evaluate

    rng = random.Random(7)
    base = "".join(rng.choice("abc dE") for _ in range(4000))
    texts = [(i, "".join(rng.choice("abc de") for _ in range(rng.randrange(60))) + (base[i * 50 : i * 50 + rng.randrange(90)] if i % 2 else "") + "common end of all") for i in range(50)]
    texts += [(99, None), (98, ""), (97, "short")]
    asked = [(i, base[i * 150 : i * 150 + 120].upper()) for i in range(15)] + [(20, None), (21, "x" * 40), (22, "see the COMMON END of all")]

    def longest(a, b):
        a, b = (a or "").lower(), (b or "").lower()
        return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)

    questions, golds = spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(texts, "id int, text string")
    expected = {(q, i): longest(a, b) for q, a in asked for i, b in texts}
    for least in (12, 20):
        found = {(r.qid, r.id): r.overlap for r in evaluate.overlaps(questions, golds, least=least).collect()}
        assert found == {p: n for p, n in expected.items() if n >= least}
    assert evaluate.longest_common(evaluate._states("abcbc"), "zbcbz") == 3 and evaluate.longest_common(evaluate._states(""), "a") == 0
