"""Registered queries of document classes, templates, claims, Markdown, filtered questions and approximate recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import documents as D
from weftspark.operators import cells, vectors
from weftspark.plans.catalog import _V_SQL, ORACLES, QUERIES, _rounded, _vectors, query
from weftspark.sources.graph import table

__all__ = ["ORACLES", "QUERIES"]

#: Front matter that a page gets by its id, and what a question or a document gets to say by its number.
FRONT = ["", "---\ntype: Policies\ntitle: T\n---\n", "---\ntype: memo\nscope: all\n---\n", "---\ntype: sops\neffective_date: 2024-01-02\n---\n"]
SAYS = ["", "We collaborate closely with SIG Node. ", "This supersedes the older KEP-12 and KEP-13. ", "It builds on KEP-7; it depends on KEP-8. "]


def _pick(texts: list[str], key):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


def _pick_sql(texts: list[str], key: str) -> str:
    return "([" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in texts) + f"])[{key} % {len(texts)} + 1]"


def _path_sql() -> str:
    tests = " ".join(f"WHEN regexp_matches(p, '{words}') THEN '{name}'" for name, words in D.PATH_WORDS)
    return f"list_filter(list_transform(string_split(replace(url, '\\', '/'), '/'), lambda p: CASE {tests} END), lambda x: x IS NOT NULL)[1]"


_NAMES_SQL = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.CLASS_NAMES.items()) + " END"


@query(f"""WITH c AS (SELECT page_id, page_id % 4 AS m, url, CASE page_id % 4 WHEN 1 THEN 'policy' WHEN 3 THEN 'sop' ELSE coalesce({_path_sql()}, 'sop') END AS doc_type FROM pages)
SELECT page_id, doc_type, 'urn:class:' || {_NAMES_SQL} AS class_uri, CASE WHEN doc_type IN ('policy', 'standard', 'guideline') THEN 'normative' ELSE 'descriptive' END AS partition,
CASE WHEN m = 1 THEN 'T' ELSE regexp_replace(string_split(url, '/')[-1], '^(\\.*[^.].*)\\.[^.]*$', '\\1') END AS name,
CASE WHEN m = 3 THEN '2024-01-02' END AS effective_date, CASE WHEN m = 2 THEN 'all' END AS scope FROM c""")
def classify_docs(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(_pick(FRONT, F.col("page_id")), "html").alias("text"))
    return pages.select("page_id", *[c.alias(k) for k, c in D.classify(F.col("url"), F.col("text")).items()])


def _claim_sql(kind: str) -> str:
    parts = [
        f"SELECT doc_id, {i} AS rule, piece, unnest(regexp_extract_all(s, '{words}', 1)) AS object, generate_subscripts(regexp_extract_all(s, '{words}', 1), 1) AS pos, "
        f"'{name}' AS predicate, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS span FROM p WHERE kind = '{kind}'"
        for i, (name, words) in enumerate(D.RULES[kind])
    ]
    return " UNION ALL ".join(parts)


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sig' ELSE 'kep' END AS kind, text || ' . ' || {_pick_sql(SAYS, '(doc_id // 2)')} AS body FROM documents),
p AS (SELECT doc_id, kind, unnest(string_split(body, '.')) AS s, generate_subscripts(string_split(body, '.'), 1) AS piece FROM b),
f AS ({_claim_sql('sig')} UNION ALL {_claim_sql('kep')}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, piece, pos) AS n FROM f)
SELECT doc_id, predicate, object, span FROM r WHERE n <= {D.MOST_CLAIMS}""")
def rule_claims(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" . "), _pick(SAYS, F.floor(F.col("doc_id") / 2))).alias("body"))
    kind = F.when(F.col("doc_id") % 2 == 0, "sig").otherwise("kep")
    return docs.select("doc_id", F.inline(D.claims(kind, F.col("body"))))


@query(f"""WITH t AS (SELECT page_id, page_id % 4 > 0 AS cut, {_pick_sql(FRONT, 'page_id')} || '# ' || url || chr(10) || '  ## Part ' AS t FROM pages)
SELECT page_id, cut AS has_front, '# ' || (SELECT url FROM pages p WHERE p.page_id = t.page_id) AS first_heading, 2::BIGINT AS n_headings FROM t""")
def markdown_parts(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(_pick(FRONT, F.col("page_id")), F.lit("# "), "url", F.lit("\n  ## Part ")).alias("t"))
    m = D.markdown(F.col("t"))
    return pages.select("page_id", m["block"].isNotNull().alias("has_front"), F.get(m["headings"], 0).alias("first_heading"), F.size(m["headings"]).cast("long").alias("n_headings"))


@query(_V_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s
WHERE r <= 2 AND (qid // 20 % 3 = 0 OR label IN (ql, (ql + 1) % 10)))
SELECT qid, rank, chunk_id, round(score, 6) AS score FROM b WHERE rank <= 10""")
def selfquery_filtered(spark, d):
    asked, chunks = _vectors(spark, d)
    wanted = F.when(F.floor(F.col("qid") / 20) % 3 != 0, F.array(F.col("ql"), (F.col("ql") + 1) % 10))
    asked = asked.select("qid", "q", wanted.alias("wanted"), F.lit(2).alias("clearance"))
    return _rounded(vectors.knn(asked, chunks, 10))


@query()
def knn_lsh_recall(spark, d):
    """Which share of its ten nearest the approximate search finds for each question, and how many chunks it looked at."""
    asked, chunks = _vectors(spark, d)
    exact = vectors.knn(asked, chunks, 10).select("qid", "chunk_id")
    near = vectors.approximate(asked, chunks, 10)
    found = near.select("qid", "chunk_id", F.lit(1).alias("hit"))
    seen = near.groupBy("qid").agg(F.max("seen").alias("seen"))
    return exact.join(found, ["qid", "chunk_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall")).join(seen, "qid", "left")


@query(_V_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s
WHERE r <= 2 AND (qid // 20 % 3 = 0 OR label IN (ql, (ql + 1) % 10)))
SELECT qid, rank, chunk_id, round(score, 6) AS score FROM b WHERE rank <= 10""")
def knn_cells_exact(spark, d):
    """The ten nearest of those that pass each question's filter, from cells that are looked into until none left can hold a nearer one."""
    return _rounded(cells.search(cells.Cells(_vectors(spark, d)[1], cells=32), _narrowed(spark, d), 10, exact=True))


def _narrowed(spark, d):
    asked = _vectors(spark, d)[0]
    wanted = F.when(F.floor(F.col("qid") / 20) % 3 != 0, F.array(F.col("ql"), (F.col("ql") + 1) % 10))
    return asked.select("qid", "q", wanted.alias("wanted"), F.lit(2).alias("clearance"))


@query()
def knn_cells_recall(spark, d):
    """Which share of its ten nearest each question finds in its nearest cells, with and without a filter, and which share of the chunks it looks at."""
    asked, chunks = _vectors(spark, d)
    index = cells.Cells(chunks, cells=32)
    out = None
    for name, questions in (("all", asked.select("qid", "q")), ("filtered", _narrowed(spark, d))):
        exact = vectors.knn(questions, chunks, 10).select("qid", "chunk_id")
        near = cells.search(index, questions, 10, probes=8, enough=120)
        seen = near.groupBy("qid").agg(F.max("seen").alias("seen"))
        found = exact.join(near.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
        rows = found.join(seen, "qid", "left").select(F.lit(name).alias("filter"), "qid", "recall", "seen")
        out = rows if out is None else out.unionByName(rows)
    return out
