"""The registered queries over the driver's tables and their SQL.

Questions are tables: every operator answers all rows of its questions at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import delta, documents, evaluate, graph, vectors
from weftspark.sources import graph as src
from weftspark.sources.graph import MANIFEST_SQL, PG_SQL, QUADS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _graph(spark, d, kinds: list[str] | None = None):
    """Nodes, edges and adjacency, if asked for of the nodes of some kinds alone; edges of other kinds fall away with their nodes."""
    nodes, edges = src.nodes(spark, d), src.edges(spark, d)
    if kinds is not None:
        nodes = nodes.where(F.col("kind").isin(kinds))
        edges = edges.where(F.substring_index("src", ":", 1).isin(kinds) & F.substring_index("dst", ":", 1).isin(kinds))
    return nodes, edges, graph.adjacency(nodes, edges)


def _seeds(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind).select(F.col("id").alias("qid"), "id")


def _hop_sql(steps: list[tuple[str, str]], kind: str, r: int, cap: int = 50) -> str:
    parts = [f"WITH {PG_SQL}, f0 AS (SELECT id AS qid, id, 1 AS pos FROM nodes WHERE kind = '{kind}')"]
    for i, (edge, way) in enumerate(steps):
        parts.append(
            f"f{i + 1} AS (SELECT qid, id, pos FROM (SELECT qid, dst AS id, row_number() OVER (PARTITION BY qid ORDER BY fr, dst) AS pos FROM ("
            f"SELECT f.qid, a.dst, min(f.pos) AS fr FROM f{i} f JOIN adj a ON a.src = f.id AND a.kind = '{edge}' AND a.dir = '{way}' AND a.r <= {r} GROUP BY ALL)) WHERE pos <= {cap})"
        )
    return ", ".join(parts) + f" SELECT qid, id, pos FROM f{len(steps)}"


@query(_hop_sql([("IN_NATION", ">"), ("IN_REGION", ">")], "customer", 3))
def traverse_two_hop(spark, d):
    nodes, _, adj = _graph(spark, d, ["customer", "nation", "region"])
    return graph.traverse(_seeds(nodes, "customer"), adj, ["IN_NATION>", "IN_REGION>"])


@query(_hop_sql([("IN_NATION", ">"), ("IN_REGION", ">")], "customer", 2))
def traverse_clearance(spark, d):
    nodes, _, adj = _graph(spark, d, ["customer", "nation", "region"])
    return graph.traverse(_seeds(nodes, "customer"), adj, ["IN_NATION>", "IN_REGION>"], clearance=2)


@query(_hop_sql([("IN_REGION", "<"), ("IN_NATION", "<")], "region", 3))
def traverse_in_direction(spark, d):
    nodes, _, adj = _graph(spark, d, ["region", "nation", "customer", "supplier"])
    return graph.traverse(_seeds(nodes, "region"), adj, ["<IN_REGION", "<IN_NATION"])


def _expand_sql(kind: str, r: int, cap: int) -> str:
    return f"""WITH {PG_SQL}, e AS (SELECT DISTINCT src, dst FROM adj WHERE r <= {r}),
    s AS (SELECT id AS qid, id FROM nodes WHERE kind = '{kind}'),
    h1 AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (
      SELECT DISTINCT s.qid, e.dst AS id FROM s JOIN e ON e.src = s.id WHERE e.dst <> s.qid)) WHERE n <= {cap}),
    h2 AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (
      SELECT DISTINCT h1.qid, e.dst AS id FROM h1 JOIN e ON e.src = h1.id WHERE e.dst <> h1.qid) c
      WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.qid = c.qid AND h1.id = c.id)) WHERE n <= {cap})
    SELECT qid, id, 1 AS hop FROM h1 UNION ALL SELECT qid, id, 2 FROM h2"""


@query(_expand_sql("supplier", 3, 50))
def expand_neighborhood(spark, d):
    nodes = src.nodes(spark, d)
    return graph.expand(_seeds(nodes, "supplier"), graph.bare(nodes, src.edges(spark, d, once=False)))


@query(_expand_sql("nation", 3, 8))
def expand_capped(spark, d):
    nodes, _, adj = _graph(spark, d)
    return graph.expand(_seeds(nodes, "nation"), adj, cap=8)


@query(_expand_sql("supplier", 1, 50))
def expand_clearance(spark, d):
    nodes, _, adj = _graph(spark, d)
    return graph.expand(_seeds(nodes, "supplier"), adj, clearance=1)


@query(f"WITH {PG_SQL} SELECT src AS id, kind, dir, dst AS neighbour FROM adj WHERE src LIKE 'nation:%'")
def neighbors_batch(spark, d):
    nodes, _, adj = _graph(spark, d, ["region", "nation", "customer", "supplier"])
    return graph.neighbours(nodes.where("kind = 'nation'").select("id"), adj)


@query(f"WITH {PG_SQL} SELECT src AS qid, dst AS id FROM adj WHERE kind = 'PLACED' AND dir = '>'")
def template_owned(spark, d):
    nodes, _, adj = _graph(spark, d, ["customer", "order"])
    params = nodes.where("kind = 'customer'").select("id")
    return graph.neighbours(params, adj).where("kind = 'PLACED' and dir = '>'").select(F.col("id").alias("qid"), F.col("neighbour").alias("id"))


@query(f"WITH {PG_SQL} SELECT dst AS qid, src AS id FROM adj WHERE kind = 'IN_NATION' AND dir = '>' AND src LIKE 'supplier:%'")
def template_led(spark, d):
    nodes, _, adj = _graph(spark, d, ["supplier", "nation"])
    params = nodes.where("kind = 'nation'").select("id")
    led = graph.neighbours(params, adj).where("kind = 'IN_NATION' and dir = '<' and neighbour like 'supplier:%'")
    return led.select(F.col("id").alias("qid"), F.col("neighbour").alias("id"))


@query(f"WITH {PG_SQL} SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS n FROM nodes) WHERE n <= 25")
def nodes_by_kind(spark, d):
    order = Window.partitionBy("kind").orderBy("id")
    return src.nodes(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 25").select("kind", "id", "name")


@query(f"""WITH {PG_SQL}, seeds AS (SELECT conv_id AS qid, 'nation:' || (conv_id % 40) AS id FROM conversations GROUP BY conv_id)
SELECT s.qid, s.id, CASE WHEN r.r IS NULL THEN 'dropped' WHEN r.r > 2 THEN 'filtered' ELSE 'confirmed' END AS status FROM seeds s LEFT JOIN ranked r USING (id)""")
def seed_confirmation(spark, d):
    seeds = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.concat(F.lit("nation:"), (F.col("conv_id") % 40).cast("string")).alias("id")).distinct()
    return graph.confirm(seeds, src.nodes(spark, d), 2)


def _mentions(spark, d):
    parts = table(spark, d, "part").select(
        src.node_id("part", F.col("p_partkey")).alias("id"), F.lit("part").alias("source"), F.lit(1).alias("ord"),
        F.create_map(F.lit("name"), "p_name", F.lit("brand"), F.col("p_brand")).alias("props"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").cast("int").cast("string").alias("most"))
    lines = lines.select(
        src.node_id("part", F.col("l_partkey")).alias("id"), F.lit("lineitem").alias("source"), F.lit(2).alias("ord"),
        F.create_map(F.lit("name"), F.lit(None).cast("string"), F.lit("most"), F.col("most")).alias("props"),
    )
    return parts.unionByName(lines)


@query("""SELECT 'part:' || p_partkey AS id, CASE WHEN most IS NULL THEN 'part' ELSE 'lineitem,part' END AS sources, p_name AS name, p_brand AS brand, most
FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity)::INT::VARCHAR AS most FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def node_resolve(spark, d):
    found = graph.resolve(_mentions(spark, d), ["id"])
    return found.select("id", F.array_join("sources", ",").alias("sources"), *[F.col("props")[k].alias(k) for k in ("name", "brand", "most")])


@query("""SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, min(l_linenumber)::VARCHAR AS line, count(DISTINCT l_returnflag) AS n_sources
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def edge_resolve(spark, d):
    lines = table(spark, d, "lineitem").select(
        src.node_id("order", F.col("l_orderkey")).alias("src"), src.node_id("part", F.col("l_partkey")).alias("dst"),
        F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("ord"),
        F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")).alias("props"),
    )
    found = graph.resolve(lines, ["src", "dst"])
    return found.select("src", "dst", F.col("props")["line"].alias("line"), F.size("sources").cast("long").alias("n_sources"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def cross_source_merges(spark, d):
    return graph.resolve(_mentions(spark, d), ["id"]).where(F.size("sources") > 1).select("id")


@query(f"WITH {PG_SQL} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def ingest_report(spark, d):
    nodes, edges = src.nodes(spark, d), src.edges(spark, d)
    count = lambda df, what: df.groupBy("kind").count().select(F.lit(what).alias("what"), "kind", F.col("count").alias("n"))
    return count(nodes, "node").unionByName(count(edges, "edge"))


@query(r"""SELECT c_custkey AS key, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
lower(trim(regexp_replace(trim('@@' || c_mktsegment || ' '), '^@+', ''))) AS handle,
'kep-' || coalesce(nullif(regexp_replace('000' || c_custkey, '^0+', ''), ''), '0') AS number FROM customer""")
def normalize_ids(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), T.slug(F.col("c_name")).alias("slug"),
        T.handle(F.concat(F.lit("@@"), "c_mktsegment", F.lit(" "))).alias("handle"),
        T.numbered(F.concat(F.lit("KEP-000"), F.col("c_custkey").cast("string"))).alias("number"),
    )


@query(f"WITH {PG_SQL} SELECT src, kind, dst, (['public','internal','restricted'])[r] AS tier FROM adj WHERE dir = '>'")
def label_edges(spark, d):
    _, _, adj = _graph(spark, d)
    tiers = F.array(*[F.lit(t) for t in src.TIERS])
    return adj.where("dir = '>'").select("src", "kind", "dst", F.element_at(tiers, F.col("r")).alias("tier"))


@query("""SELECT doc_id, (['public','internal','restricted'])[greatest(doc_id % 3, length(source) % 3) + 1] AS tier FROM documents""")
def label_chunks(spark, d):
    owners = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.col("doc_id") % 3, (F.length("source") % 3).cast("long"))).alias("key"))
    tiers = F.array(*[F.lit(t) for t in src.TIERS])
    ranked = owners.select("doc_id", graph.rank(src.tier_of(F.col("key"))).alias("r")).groupBy("doc_id").agg(F.max("r").alias("r"))
    return ranked.select("doc_id", F.element_at(tiers, F.col("r")).alias("tier"))


_DIFF_SQL = f"""WITH {MANIFEST_SQL}, d AS (
  SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, p.hash AS old_hash, c.hash AS new_hash,
         CASE WHEN p.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'deleted' WHEN p.hash <> c.hash THEN 'changed' END AS action
  FROM prev p FULL JOIN cur c ON p.doc_id = c.doc_id),
m AS (SELECT a.doc_id AS old_doc_id, b.doc_id AS new_doc_id, a.old_hash AS hash FROM
  (SELECT *, row_number() OVER (PARTITION BY old_hash ORDER BY doc_id) AS n FROM d WHERE action = 'deleted') a JOIN
  (SELECT *, row_number() OVER (PARTITION BY new_hash ORDER BY doc_id) AS n FROM d WHERE action = 'added') b ON a.old_hash = b.new_hash AND a.n = b.n)"""


@query(_DIFF_SQL + " SELECT doc_id, action FROM d WHERE action IS NOT NULL")
def manifest_diff(spark, d):
    return delta.diff(*src.manifests(spark, d)).select("doc_id", "action")


@query(_DIFF_SQL + " SELECT * FROM m")
def move_pairs(spark, d):
    return delta.moves(delta.diff(*src.manifests(spark, d)))


@query(_DIFF_SQL + """ SELECT action, count(*) AS n FROM d WHERE action IS NOT NULL AND doc_id NOT IN (SELECT old_doc_id FROM m)
AND doc_id NOT IN (SELECT new_doc_id FROM m) GROUP BY action UNION ALL SELECT 'moved', count(*) FROM m""")
def delta_counts(spark, d):
    return delta.with_moves(delta.diff(*src.manifests(spark, d))).groupBy("action").agg(F.count("*").alias("n"))


def _reconciled(spark, d):
    lines = table(spark, d, "lineitem")
    store = lines.select(src.node_id("supplier", F.col("l_suppkey")).alias("s"), src.node_id("part", F.col("l_partkey")).alias("p"), F.col("l_orderkey").alias("doc"))
    gone = lines.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("doc")).distinct()
    fresh = store.where("doc % 21 = 0")
    return delta.reconcile(store, fresh, gone, ["s", "p"])


_RECONCILE_SQL = """WITH store AS (SELECT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS p, l_orderkey AS doc FROM lineitem),
o AS (SELECT s, p, list_sort(list(DISTINCT doc)) AS had FROM store GROUP BY s, p),
k AS (SELECT s, p, list_sort(list(DISTINCT doc)) AS docs FROM store WHERE doc % 3 <> 0 OR doc % 21 = 0 GROUP BY s, p),
r AS (SELECT s, p, CASE WHEN docs IS NULL THEN 'delete' WHEN docs <> had THEN 'upsert' END AS action, len(docs) AS n FROM o LEFT JOIN k USING (s, p))"""


@query(_RECONCILE_SQL + " SELECT s, p, action, coalesce(n, 0)::BIGINT AS n_docs FROM r WHERE action IS NOT NULL")
def graph_reconcile(spark, d):
    return _reconciled(spark, d).select("s", "p", "action", F.coalesce(F.size("docs"), F.lit(0)).cast("long").alias("n_docs"))


@query("""SELECT src, kind, dst FROM (SELECT 'customer:' || c_custkey AS src, 'IN_NATION' AS kind, 'nation:' || c_nationkey AS dst, c_custkey AS k FROM customer
UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey, o_custkey FROM orders) WHERE k % 10 = 3""")
def orphan_cascade(spark, d):
    """Edges that go with the customers that a delta deletes."""
    nodes, edges = src.nodes(spark, d), src.edges(spark, d)
    gone = nodes.where("kind = 'customer' and cast(substring_index(id, ':', -1) as long) % 10 = 3").select("id")
    return delta.cascaded(edges, gone)


def _cache(spark, d):
    before, after = src.manifests(spark, d)
    fp = F.lit("f1").alias("fp")
    return delta.cached(after.select("doc_id", fp, "hash"), before.select(fp, "hash"))


@query(f"WITH {MANIFEST_SQL} SELECT doc_id, hash FROM cur WHERE hash IN (SELECT hash FROM prev)")
def silver_hits(spark, d):
    return _cache(spark, d)[0].select("doc_id", "hash")


@query(f"WITH {MANIFEST_SQL} SELECT doc_id, hash FROM cur WHERE hash NOT IN (SELECT hash FROM prev)")
def silver_misses(spark, d):
    return _cache(spark, d)[1].select("doc_id", "hash")


def _vectors(spark, d):
    """(questions, chunks): every vector whose id is divisible by 20 asks, against all of them."""
    chunks = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label", F.floor(F.col("vec_id") / 5).alias("parent_id"), (F.col("vec_id") % 3 + 1).alias("r")
    )
    asked = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("ql"))
    return asked, chunks


_V_SQL = """WITH c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label, vec_id // 5 AS parent_id, vec_id % 3 + 1 AS r FROM embeddings),
q AS (SELECT chunk_id AS qid, v AS q, label AS ql FROM c WHERE chunk_id % 20 = 0),
s AS (SELECT qid, ql, chunk_id, parent_id, label, r, list_cosine_similarity(q, v) AS score FROM q, c)"""


def _best_sql(where: str = "true", k: int = 10) -> str:
    return f"{_V_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE {where}) SELECT qid, rank, chunk_id, round(score, 6) AS score FROM b WHERE rank <= {k}"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(_best_sql())
def knn_topk(spark, d):
    return _rounded(vectors.knn(*_vectors(spark, d), 10))


@query(_best_sql("label IN (ql, (ql + 1) % 10)"))
def knn_filtered(spark, d):
    asked, chunks = _vectors(spark, d)
    return _rounded(vectors.knn(asked.withColumn("wanted", F.array(F.col("ql"), (F.col("ql") + 1) % 10)), chunks, 10))


@query(_best_sql("r <= qid // 20 % 3 + 1"))
def knn_visible(spark, d):
    asked, chunks = _vectors(spark, d)
    return _rounded(vectors.knn(asked.withColumn("clearance", F.floor(F.col("qid") / 20) % 3 + 1), chunks, 10))


@query(_V_SQL + ", p AS (SELECT qid, parent_id, max(score) AS score, arg_max(chunk_id, (score, -chunk_id)) AS child FROM s GROUP BY qid, parent_id), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent_id) AS rank FROM p) SELECT qid, rank, parent_id, child, round(score, 6) AS score FROM b WHERE rank <= 5")
def parent_child_topk(spark, d):
    return vectors.parents(*_vectors(spark, d), 5).withColumn("score", F.round("score", 6))


@query(_best_sql("score >= 0.3", 1000))
def vector_threshold(spark, d):
    """Up to a thousand chunks that are similar enough."""
    return _rounded(vectors.knn(*_vectors(spark, d), 1000, least=0.3))


@query(_V_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s), g AS (
  SELECT q.qid, qid % 100 = 0 AS expect_miss, c.chunk_id AS gold FROM q JOIN c ON c.chunk_id = CASE WHEN qid % 100 = 0 THEN (qid * 7 + 3) % (SELECT count(*) FROM c) ELSE qid END),
e AS (SELECT g.qid, expect_miss, min(b.rank) AS rank FROM g LEFT JOIN b ON b.qid = g.qid AND b.chunk_id = g.gold AND b.rank <= 10 GROUP BY ALL)
SELECT round(coalesce(avg(CASE WHEN NOT expect_miss THEN (rank IS NOT NULL)::INT END), 1.0), 6) AS hit_rate, round(coalesce(avg(CASE WHEN NOT expect_miss THEN coalesce(1.0 / rank, 0) END), 1.0), 6)::DOUBLE AS mrr,
  bool_and(CASE WHEN expect_miss THEN rank IS NULL ELSE rank IS NOT NULL END) AS passes FROM e""")
def hit_at_k_mrr(spark, d):
    """Hit rate and reciprocal rank of questions whose own chunk is gold, and whether the misses that are expected are missed."""
    asked, chunks = _vectors(spark, d)
    miss = F.col("qid") % 100 == 0
    size = chunks.agg(F.count("*").alias("n"))
    gold = asked.join(F.broadcast(size)).select("qid", miss.alias("expect_miss"), F.when(miss, (F.col("qid") * 7 + 3) % F.col("n")).otherwise(F.col("qid")).alias("gold"))
    return evaluate.retrieval(gold, vectors.knn(asked, chunks, 10), chunks)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 256 AS idx, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w WHERE w <> '')
SELECT doc_id, idx, sum(sign)::BIGINT AS value FROM h GROUP BY doc_id, idx HAVING sum(sign) <> 0""")
def hash_embed_dims(spark, d):
    return vectors.hash_embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query(r"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, greatest(length(text), 1) + 1, 850), lambda i: substr(text, i, 1000)), lambda x: trim(x, E' \t\n\r') <> '')) AS t FROM documents)
SELECT doc_id, count(*) AS n, sum(length(t))::BIGINT AS chars FROM p GROUP BY doc_id""")
def chunk_windows(spark, d):
    return T.windows(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


_SENTENCE_SQL = r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r') <> '') AS p FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, p, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS open, 0::BIGINT AS chars FROM s WHERE len(p) > 0
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN fl THEN list_append(done, array_to_string(open, ' ')) ELSE done END,
    list_append(CASE WHEN fl THEN open[len(open) - kept + 1:] ELSE open END, x), length(x) + CASE WHEN fl THEN coalesce(list_sum(list_transform(open[len(open) - kept + 1:], lambda y: length(y))), 0) ELSE chars END
  FROM (SELECT *, p[i + 1] AS x, len(open) > 0 AND chars + length(p[i + 1]) > 2048 AS fl,
    len(list_filter(range(1, len(open) + 1), lambda k: list_sum(list_transform(open[len(open) - k + 1:], lambda y: length(y))) <= 256)) AS kept FROM f WHERE i < len(p)))
SELECT doc_id, generate_subscripts(c, 1) - 1 AS ordinal, unnest(c) AS text FROM (SELECT doc_id, list_append(done, array_to_string(open, ' ')) AS c FROM f WHERE i = len(p))"""


@query(_SENTENCE_SQL)
def chunk_sentences(spark, d):
    return T.sentences(table(spark, d, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "text")


@query(f"SELECT doc_id, {', '.join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS n_{k}" for k, p in T.DETECTORS.items())} FROM documents")
def pii_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in T.pii_counts(F.col("text")).items()])


#: What a document gets to hold besides its text, by its number: header lines, control characters, personal data, too little.
EXTRA = ["", "Page 3 of 12\n  page 4  \n17\n-- 5 --\n", "CONFIDENTIAL: do not pass on\nproprietary notice\nInternal  Use Only\nConfidentiality matters here\n", "{control}", "{short}",
         "call +1 (415) 555-0199 or +44 20 7946 0958, NI AB 12 34 56 C, TFN 123 456 782, SSN 123-45-6789, card 4111 1111 1111 1111, a.b@c.org\n", "{flat}"]
_EXTRA_SQL = f"""texts AS (SELECT doc_id, source, CASE doc_id % 7 WHEN 3 THEN repeat(chr(1) || chr(7), length(text)) || text WHEN 4 THEN left(text, 150) WHEN 6 THEN repeat('ab ' || chr(10), 80)
  ELSE ([{', '.join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in EXTRA)}])[doc_id % 7 + 1] || text END AS text FROM documents)"""
_SPLIT = "(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END)"
_CLEAN_SQL = f"""{_EXTRA_SQL}, ls AS (SELECT *, {_SPLIT} AS ls FROM (SELECT *, regexp_split_to_array(text, '{T.LINE_END}') AS l FROM texts)),
hs AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(trim(x, E' \\t\\n\\r\\x0b\\x0c'), '{T.HEADER}')) AS kept FROM ls),
plain AS (SELECT *, len(ls) - len(kept) AS headers, array_to_string(kept, chr(10)) AS p FROM hs),
bin AS (SELECT *, len(regexp_extract_all(p, '{T.CONTROL}')) / greatest(length(p), 1) >= {T.CONTROL_SHARE} AS residue FROM plain),
clean AS (SELECT *, CASE WHEN residue THEN regexp_replace(p, '{T.CONTROL}', '', 'g') ELSE p END AS c FROM bin),
gated AS (SELECT *, length(trim(c, E' \\t\\n\\r\\x0b\\x0c')) AS n, regexp_matches(c, '{T.HEADING}') OR regexp_matches(c, '{T.PARAGRAPH}') AS ok,
  {' + '.join(f"len(regexp_extract_all(c, '{p}'))" for p in T.DETECTORS.values())} AS pii FROM clean),
report AS (SELECT *, CASE WHEN n < {T.LEAST_CHARS} THEN 'min_content (observed: ' || n || ' chars)' WHEN NOT ok THEN 'structure' END AS failed FROM gated)"""


def _texts(spark, d):
    number = (F.col("doc_id") % 7).cast("int")
    held = F.when(number == 3, F.concat(F.repeat(F.lit("\x01\x07"), F.length("text")), "text")).when(number == 4, F.substring("text", 1, 150)).when(number == 6, F.repeat(F.lit("ab \n"), F.lit(80)))
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce(held, F.concat(F.element_at(F.array(*[F.lit(x) for x in EXTRA]), number + 1), "text")).alias("text"))


@query(f"WITH {_CLEAN_SQL} SELECT doc_id, failed AS reason FROM report WHERE failed IS NOT NULL")
def quarantine_gates(spark, d):
    found = T.cleansed(_texts(spark, d))
    return found.where("quarantined").select("doc_id", F.col("gate_failed").alias("reason"))


@query(f"""WITH {_CLEAN_SQL} SELECT doc_id, length(text)::BIGINT AS chars_raw, length(c)::BIGINT AS chars_clean, headers::BIGINT AS headers_stripped, residue::BIGINT AS binary_stripped,
CASE WHEN failed IS NULL THEN 'min_content,structure' WHEN failed = 'structure' THEN 'min_content' ELSE '' END AS gates_passed, failed AS gate_failed, failed IS NOT NULL AS quarantined,
CASE WHEN failed IS NULL THEN pii ELSE 0 END::BIGINT AS pii_entities, failed IS NULL AND pii > 0 AS pii_flagged FROM report""")
def cleanse_documents(spark, d):
    """The report of every document, quarantined or not."""
    return T.cleansed(_texts(spark, d)).drop("source", "text", "clean_text")


@query(f"""WITH {_CLEAN_SQL} SELECT source, count(*) AS docs, count(failed) AS quarantined, sum(headers)::BIGINT AS headers, count(*) FILTER (WHERE residue) AS residue,
sum(CASE WHEN failed IS NULL THEN pii ELSE 0 END)::BIGINT AS pii FROM report GROUP BY source""")
def cleanse_report(spark, d):
    return T.cleansed(_texts(spark, d)).groupBy("source").agg(
        F.count("*").alias("docs"), F.count("gate_failed").alias("quarantined"), F.sum("headers_stripped").alias("headers"), F.sum("binary_stripped").alias("residue"), F.sum("pii_entities").alias("pii")
    )


@query(f"WITH {_CLEAN_SQL} SELECT doc_id, headers::BIGINT AS dropped, sha256(p) AS kept_sha256 FROM plain")
def header_strip(spark, d):
    return _texts(spark, d).select("doc_id", T.headers(F.col("text")).alias("dropped"), F.sha2(T.without_headers(F.col("text")), 256).alias("kept_sha256"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS section,
CASE WHEN regexp_matches(url, '\.(md|html?)([?#]|$)') THEN 'passthrough' WHEN regexp_matches(url, '\.pdf([?#]|$)') THEN 'converter' ELSE 'error' END AS route FROM pages""")
def format_route(spark, d):
    url = F.col("url")
    route = F.when(url.rlike(r"\.(md|html?)([?#]|$)"), "passthrough").when(url.rlike(r"\.pdf([?#]|$)"), "converter").otherwise("error")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("section"), route.alias("route"))


@query(f"""WITH {QUADS_SQL} SELECT s, p AS predicate, o AS value FROM quads WHERE g = 'normative'""")
def emit_triples(spark, d):
    return src.quads(spark, d).where("g = 'normative'").select("s", F.col("p").alias("predicate"), F.col("o").alias("value"))


_SHAPE_SQL = f"""WITH {QUADS_SQL}, bad AS (
  SELECT s, 'effectiveDate' AS path, 'minCount' AS rule FROM docs WHERE day IS NULL AND type IN ('Policy', 'Standard', 'Guideline')
  UNION ALL SELECT s, 'gitCommitSHA', 'minCount' FROM docs WHERE type <> 'Concept')"""


@query(_SHAPE_SQL + " SELECT s, path, rule FROM bad")
def shape_violations(spark, d):
    return documents.violations(src.quads(spark, d), documents.shapes(spark)).select("s", "path", "rule")


@query(_SHAPE_SQL + ", r AS (SELECT s, string_agg(path || ':' || rule, ';' ORDER BY path) AS reasons FROM bad GROUP BY s) SELECT d.s, CASE WHEN r.s IS NULL THEN 'loaded' ELSE 'quarantined' END AS outcome, coalesce(reasons, '') AS reasons FROM docs d LEFT JOIN r ON r.s = d.s")
def gate_outcomes(spark, d):
    quads = src.quads(spark, d)
    return documents.gated(quads, documents.violations(quads, documents.shapes(spark)))


@query(f"WITH {QUADS_SQL} SELECT type AS kind, count(*) AS n, (type IN ('Policy', 'Standard', 'Guideline'))::INT AS dated FROM docs GROUP BY type")
def class_completeness(spark, d):
    """Classes in use, and whether a shape asks for their date."""
    used = src.quads(spark, d).where("p = 'type'").groupBy(F.col("o").alias("kind")).agg(F.count("*").alias("n"))
    dated = documents.shapes(spark).where("path = 'effectiveDate'").select(F.col("target_class").alias("kind"), F.lit(1).alias("dated"))
    return used.join(F.broadcast(dated), "kind", "left").select("kind", "n", F.coalesce("dated", F.lit(0)).alias("dated"))


_REPO = "corpus"


def _chain(spark, d):
    s = F.concat(F.lit("urn:doc:"), "source", F.lit(":"), F.col("doc_id").cast("string"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    docs = table(spark, d, "documents").select(F.lit("x").alias("g"), s.alias("s"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"), F.lit("passthrough").alias("extractor"), at.alias("started"), at.alias("ended"))
    return docs, documents.provenance(docs, _REPO)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT unnest(['gitCommitSHA', 'gitPath', 'gitRepo', 'used', 'wasAssociatedWith', 'startedAtTime', 'endedAtTime', 'wasGeneratedBy', 'wasDerivedFrom']) AS p, unnest([1, 1, 1, 2, 2, 1, 1, 2, 2]) AS k)
SELECT p, k * n AS n FROM c, n UNION ALL SELECT 'type', 5 * n + 2 FROM n""")
def prov_chain(spark, d):
    return _chain(spark, d)[1].groupBy("p").agg(F.count("*").alias("n"))


@query(f"WITH {QUADS_SQL} SELECT s, name AS title, type AS kind, g AS partition, sha256(text) AS sha, source || '/' || doc_id AS path FROM docs JOIN documents USING (doc_id)")
def citations(spark, d):
    """The source at its commit of every document, over the chain of what made it."""
    docs, chain = _chain(spark, d)
    asked = docs.select(F.col("s").alias("uri"), F.lit(1.0).alias("relevance"))
    found = documents.resolve_citations(asked, src.quads(spark, d), chain, docs.limit(0).select("s", F.col("sha").alias("text")))
    return found.select(F.col("uri").alias("s"), "title", F.col("doc_type").alias("kind"), "partition", F.col("commit_sha").alias("sha"), F.col("git_path").alias("path"))


@query(f"WITH {QUADS_SQL} SELECT s, type AS kind, name, scope, day, pii = 'true' AS withheld FROM docs WHERE g = 'normative' AND (day IS NULL OR day <= '2024-06-30')")
def normative_exhaustive(spark, d):
    return documents.normative(src.quads(spark, d), "2024-06-30").withColumnRenamed("pii", "withheld").drop("domains")


@query(f"WITH {QUADS_SQL} SELECT scope, count(*) AS n, count(day) AS dated FROM docs WHERE type = 'Policy' GROUP BY scope")
def policies_by_domain(spark, d):
    rows = documents.get_policies(src.quads(spark, d))
    return rows.groupBy(F.col("domain").alias("scope")).agg(F.count("*").alias("n"), F.count("effective_date").alias("dated"))


@query(f"WITH {QUADS_SQL} SELECT g, count(*) AS n FROM quads WHERE s NOT IN (SELECT s FROM docs WHERE pii = 'true') GROUP BY g")
def taxonomy_delete(spark, d):
    quads = src.quads(spark, d)
    return documents.removed(quads, quads.where("p = 'hasPII' and o = 'true'").select("s")).groupBy("g").agg(F.count("*").alias("n"))


@query(f"WITH {PG_SQL}, c AS (SELECT src AS id, dst AS community FROM edges WHERE kind = 'IN_NATION') SELECT c.community, count(*) AS size, (['public','internal','restricted'])[max(r)] AS tier FROM c JOIN ranked USING (id) GROUP BY c.community")
def community_stats(spark, d):
    nodes, edges = src.nodes(spark, d), src.edges(spark, d)
    member = edges.where("kind = 'IN_NATION'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    tiers = F.array(*[F.lit(t) for t in src.TIERS])
    found = member.join(nodes.select("id", graph.rank(F.col("tier")).alias("r")), "id").groupBy("community").agg(F.count("*").alias("size"), F.max("r").alias("r"))
    return found.select("community", "size", F.element_at(tiers, F.col("r")).alias("tier"))


@query("SELECT event_type AS tool, count(*) AS calls, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE value < 0) AS errors, round(count(*) FILTER (WHERE user_id % 2 = 0) * 1.0 / count(*), 6)::DOUBLE AS share FROM events GROUP BY event_type")
def tool_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(
        F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") < 0).alias("errors"),
        F.round(F.count_if(F.col("user_id") % 2 == 0) / F.count("*"), 6).alias("share"),
    )


@query("SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE props END AS kept FROM events")
def redact_attrs(spark, d):
    """Attributes of spans without those on the deny list."""
    key = F.when(F.col("user_id") % 5 == 0, "prompt").otherwise("props")
    attrs = F.create_map(key, F.col("props"), F.lit("question"), F.col("event_type"))
    deny = F.array(*[F.lit(x) for x in ("prompt", "question", "answer")])
    rows = table(spark, d, "events").select("event_id", "event_type", F.map_filter(attrs, lambda k, v: ~F.array_contains(deny, k)).alias("a"))
    return rows.select("event_id", "event_type", F.col("a")["props"].alias("kept"))


@query("""WITH m AS (SELECT 'person:' || lower(CASE l_linenumber % 3 WHEN 0 THEN 'Supplier' || l_suppkey WHEN 1 THEN '@supplier' || l_suppkey ELSE ' SUPPLIER' || (l_suppkey % 97) || ' ' END) AS pred, l_suppkey AS gold FROM lineitem),
p AS (SELECT replace(replace(pred, '@', ''), ' ', '') AS pred, gold FROM m), n AS (SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT (SELECT sum(n * (n - 1) // 2)::BIGINT FROM n) AS tp, (SELECT sum(m * (m - 1) // 2)::BIGINT FROM (SELECT pred, sum(n)::BIGINT AS m FROM n GROUP BY pred)) AS pp,
  (SELECT sum(m * (m - 1) // 2)::BIGINT FROM (SELECT gold, sum(n)::BIGINT AS m FROM n GROUP BY gold)) AS gp)
SELECT tp, pp - tp AS fp, gp - tp AS fn, round(CASE WHEN pp = 0 THEN 1 ELSE tp / pp END, 6)::DOUBLE AS precision, round(CASE WHEN gp = 0 THEN 1 ELSE tp / gp END, 6)::DOUBLE AS recall, tp >= 0.8 * pp AND tp >= 0.8 * gp AS passes FROM t""")
def pairwise_pr(spark, d):
    """Mentions of suppliers in three spellings, one of them wrong for some, resolved by handle and held against their keys."""
    key, way = F.col("l_suppkey"), F.col("l_linenumber") % 3
    said = F.when(way == 0, F.concat(F.lit("Supplier"), key.cast("string"))).when(way == 1, F.concat(F.lit("@supplier"), key.cast("string"))).otherwise(F.concat(F.lit(" SUPPLIER"), (key % 97).cast("string"), F.lit(" ")))
    mentions = table(spark, d, "lineitem").select(key.alias("gold"), F.concat(F.lit("person:"), T.handle(said)).alias("pred"))
    return evaluate.pairwise(mentions)


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'forbidden_clause'
WHEN 1 THEN 'MATCH (n:' || event_type || ') RETURN n LIMIT 100' ELSE 'MATCH (n:' || event_type || ') RETURN n LIMIT 100' END AS verdict FROM events) GROUP BY verdict""")
def screen_cypher(spark, d):
    kind = F.col("event_type")
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("MATCH (n:"), kind, F.lit(") DELETE n"))).when(
        F.col("user_id") % 3 == 1, F.concat(F.lit("MATCH (n:"), kind, F.lit(") RETURN n"))
    ).otherwise(F.concat(F.lit("MATCH (n:"), kind, F.lit(") RETURN n LIMIT 5000")))
    return table(spark, d, "events").select(T.screened(text).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


_PATHS = ["(n:{kind})", "(a:{kind})-[r:REL*1..3]->(n)", "(a:{kind})-[*2..]->(n)", "(a:{kind})-[r:REL *.. 5]->(n)", "(a:{kind})-[r:REL* ]->(n)", "(a:{kind})-[r:REL*2]->(n)"]
_CLAUSES = ["", " WHERE n.x = 1", " SET n.x = 1", " WHERE n.t = 'return'", "", " DETACH", ""]
_LIMITS = ["", " LIMIT 5", " limit 5000", " LIMIT 99999999999999999999", " LIMIT 100 SKIP 300", " LIMIT 00007", " ORDER BY n.id"]
_CUT = ["", " LIMIT 5", " limit 100", " LIMIT 100", " LIMIT 100 SKIP 300", " LIMIT 00007", " ORDER BY n.id"]
_ENDS = ["", ";", " ; \n"]


def _sql_list(parts):
    quoted = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{kind}", "' || event_type || '") + "'" for p in parts]
    return "[" + ", ".join(quoted) + "]"


@query(f"""WITH t AS (SELECT event_id, user_id % {len(_PATHS)} AS p, event_id % {len(_CLAUSES)} AS c, event_id // 3 % {len(_LIMITS)} AS l, user_id // 7 % 11 = 0 AS two, event_id % 53 = 0 AS blank,
({_sql_list(_PATHS)})[user_id % {len(_PATHS)} + 1] AS path, ({_sql_list(_CLAUSES)})[event_id % {len(_CLAUSES)} + 1] AS clause, ({_sql_list(_CUT)})[event_id // 3 % {len(_LIMITS)} + 1] AS cut FROM events)
SELECT event_id, CASE WHEN blank THEN 'empty' WHEN two THEN 'multiple_statements' WHEN c IN (2, 5) THEN 'forbidden_clause' WHEN c = 3 THEN 'one_return' WHEN p IN (2, 4) THEN 'unbounded_path'
ELSE 'MATCH ' || path || clause || ' RETURN n' || cut || CASE WHEN l IN (0, 6) THEN ' LIMIT 100' ELSE '' END END AS verdict FROM t""")
def screen_queries(spark, d):
    """The verdict on each logged query, put together from paths, clauses, limits and endings; what passes has its row limit."""
    pick = lambda parts, i: F.element_at(F.array(*[F.lit(p) for p in parts]), (i + 1).cast("int"))
    user, event = F.col("user_id"), F.col("event_id")
    path = F.replace(pick(_PATHS, user % len(_PATHS)), F.lit("{kind}"), F.col("event_type"))
    two = F.when(F.floor(user / 7) % 11 == 0, "; MATCH (m) RETURN m").otherwise("")
    text = F.concat(F.lit(" \nMATCH "), path, pick(_CLAUSES, event % len(_CLAUSES)), F.lit(" RETURN n"), pick(_LIMITS, F.floor(event / 3) % len(_LIMITS)), two, pick(_ENDS, event % len(_ENDS)))
    return table(spark, d, "events").select("event_id", T.screened(F.when(event % 53 == 0, " \t ").otherwise(text)).alias("verdict"))
