"""Registered queries of communities and of answers over them, and of labelled checks of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.functions import text as T
from weftspark.operators import community, evaluate, hybrid, overview, vectors
from weftspark.plans.catalog import _V_SQL, ORACLES, QUERIES, _vectors, query
from weftspark.sources import org
from weftspark.sources.graph import table
from weftspark.sources.org import ORG_SQL

__all__ = ["ORACLES", "QUERIES"]

_MEMBER_SQL = """m AS (SELECT id, id AS community FROM nodes WHERE kind = 'sig' UNION ALL SELECT dst, src FROM edges WHERE kind = 'OWNS' UNION ALL SELECT src, dst FROM edges WHERE kind IN ('CHAIRS', 'TECH_LEADS')),
docs AS (SELECT 'person:supplier' || l_suppkey AS id, 'line-' || (l_suppkey % 7) AS doc FROM lineitem GROUP BY ALL),
rel AS (SELECT a.community, string_agg(e.src || ' -' || e.kind || '-> ' || e.dst, '; ' ORDER BY e.src || ' -' || e.kind || '-> ' || e.dst) AS rels FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND a.community = b.community GROUP BY 1),
own AS (SELECT m.community, list_sort(list(DISTINCT d.doc)) AS docs FROM m JOIN docs d USING (id) GROUP BY 1),
told AS (SELECT m.community, count(*) AS size, arg_min(k.title, k.id) AS first, max(k.r) AS tier_rank, string_agg(m.id, ', ' ORDER BY m.id) AS ids FROM m JOIN nodes k USING (id) GROUP BY 1),
s AS (SELECT t.community, first || CASE WHEN size > 1 THEN ' +' || (size - 1) || ' more' ELSE '' END AS title, size, tier_rank,
  'Answer to: Relationships within the community: ' || coalesce(rels, '(no internal relationships)') || ' Graph facts: ' || ids || '.' AS summary, coalesce(docs, []) AS docs FROM told t LEFT JOIN rel USING (community) LEFT JOIN own USING (community))"""


def _members(spark, d):
    nodes, edges = org.nodes(spark, d), org.edges(spark, d)
    lead = edges.where("kind in ('CHAIRS', 'TECH_LEADS')").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    owned = edges.where("kind = 'OWNS'").select(F.col("dst").alias("id"), F.col("src").alias("community"))
    return nodes.where("kind = 'sig'").select("id", F.col("id").alias("community")).unionByName(owned).unionByName(lead), nodes, edges


def _told(spark, d):
    members, nodes, edges = _members(spark, d)
    docs = table(spark, d, "lineitem").select(F.concat(F.lit("person:supplier"), F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("line-"), (F.col("l_suppkey") % 7).cast("string")).alias("doc")).distinct()
    return overview.summaries(members, nodes, edges, docs)


@query(f"WITH {ORG_SQL}, {_MEMBER_SQL} SELECT community, title, size, tier_rank::INT AS tier_rank, sha256(summary) AS summary_sha256, array_to_string(docs, ',') AS docs FROM s")
def summarize_communities(spark, d):
    """What is told of each group with its proposals and leaders."""
    return _told(spark, d).select("community", "title", "size", "tier_rank", F.sha2("summary", 256).alias("summary_sha256"), F.array_join("docs", ",").alias("docs"))


@query(f"WITH {ORG_SQL}, {_MEMBER_SQL} SELECT a.community, e.src, e.kind, e.dst FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND a.community = b.community")
def intra_community_edges(spark, d):
    members, _, edges = _members(spark, d)
    return overview.intra_edges(members, edges)


@query(f"""WITH {ORG_SQL}, {_MEMBER_SQL}, asked AS (SELECT DISTINCT conv_id AS qid, conv_id % 3 + 1 AS level FROM conversations),
sv AS (SELECT qid, community, rank FROM (SELECT l.level, s.community, row_number() OVER (PARTITION BY l.level ORDER BY s.size DESC, s.community) AS rank FROM (SELECT DISTINCT level FROM asked) l JOIN s ON s.tier_rank <= l.level) JOIN asked USING (level) WHERE rank <= 16),
v AS (SELECT qid, rank, sv.community, s.docs, title || ' tells of ' || qid AS answer FROM sv JOIN s USING (community) WHERE (qid + rank) % 4 = 0),
dd AS (SELECT qid, list_sort(list(DISTINCT x)) AS ds FROM (SELECT qid, unnest(docs) AS x FROM v) GROUP BY qid)
SELECT a.qid, coalesce(string_agg(answer, chr(10) ORDER BY rank), '{overview.NOTHING}') AS answer, count(answer) AS n,
coalesce(string_agg('community:' || community, ',' ORDER BY rank), '') || CASE WHEN any_value(ds) IS NOT NULL AND len(any_value(ds)) > 0 THEN ',' || array_to_string(any_value(ds), ',') ELSE '' END AS citations
FROM (SELECT DISTINCT qid FROM sv) a LEFT JOIN v USING (qid) LEFT JOIN dd USING (qid) GROUP BY a.qid""")
def global_query(spark, d):
    """For each conversation the largest communities it may see, what each says, and the relevant ones' answer with citations."""
    told = _told(spark, d)
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), (F.col("conv_id") % 3 + 1).alias("r")).distinct()
    served = hybrid.served(told.select("community", "size", F.col("tier_rank").alias("r")), asked)
    say = F.when((F.col("qid") + F.col("rank")) % 4 == 0, F.concat("title", F.lit(" tells of "), F.col("qid").cast("string"))).otherwise(" NOT RELEVANT\n")
    judged = overview.verdicts(served.select("qid", "rank", "community"), told.select("community", "title"), F.regexp_replace(say, "\\s+$", " "))
    return overview.global_answers(judged, told).withColumn("citations", F.array_join("citations", ","))


@query()
def communities_louvain(spark, d):
    """Communities of groups, people and proposals by modularity, numbered by size."""
    nodes, edges = org.nodes(spark, d), org.edges(spark, d).where("kind <> 'AUTHORS'")
    return community.numbered(community.louvain(nodes, edges))


@query(_V_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE r <= 2),
g AS (SELECT qid, 'visible' AS kind, qid AS id FROM q UNION ALL SELECT qid, 'filtered', qid + 1 FROM q UNION ALL SELECT qid, 'excluded', qid + 3 FROM q)
SELECT g.qid, kind, count(*) AS wanted, coalesce(string_agg(CASE WHEN (kind = 'visible') <> (b.chunk_id IS NOT NULL) THEN g.id::VARCHAR END, ','), '') AS missing, bool_and((kind = 'visible') = (b.chunk_id IS NOT NULL)) AS passes
FROM g LEFT JOIN b ON b.qid = g.qid AND b.chunk_id = g.id AND b.rank <= 10 GROUP BY g.qid, kind""")
def gold_checks(spark, d):
    """Whether each question's labelled chunks are seen or held back as a member's clearance says."""
    asked, chunks = _vectors(spark, d)
    got = vectors.knn(asked.withColumn("clearance", F.lit(2)), chunks, 10).select("qid", F.col("chunk_id").alias("id"))
    one = lambda kind, id_: asked.select("qid", F.lit(kind).alias("kind"), id_.alias("id"))
    gold = one("visible", F.col("qid")).unionByName(one("filtered", F.col("qid") + 1)).unionByName(one("excluded", F.col("qid") + 3))
    return evaluate.gold_checks(gold, got)


@query("""WITH q AS (SELECT item_id AS qid, lower(text) AS t FROM benchmark), g AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
qr AS (SELECT qid, i, substr(t, i, 40) AS run FROM (SELECT qid, t, unnest(range(1, length(t) - 38)) AS i FROM q)),
gr AS (SELECT id, i, substr(t, i, 40) AS run FROM (SELECT id, t, unnest(range(1, length(t) - 38)) AS i FROM g)),
m AS (SELECT qid, id, qr.i, gr.i - qr.i AS d FROM qr JOIN gr USING (run)), s AS (SELECT qid, id, d, i - row_number() OVER (PARTITION BY qid, id, d ORDER BY i) AS island FROM m),
o AS (SELECT qid, id, count(*) + 39 AS n FROM s GROUP BY qid, id, d, island)
SELECT qid, id, max(n)::BIGINT AS overlap FROM o GROUP BY qid, id""")
def wording_overlap(spark, d):
    """All items and documents whose whole texts have 40 characters or more in common, and how many."""
    golds = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluate.overlaps(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), golds, least=40)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 256 AS idx, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w WHERE w <> ''),
v AS (SELECT doc_id, idx, sum(sign)::DOUBLE AS value FROM h GROUP BY ALL HAVING sum(sign) <> 0), n AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM v GROUP BY 1)
SELECT v.doc_id, count(*) AS dims, round(sum(value / norm * value / norm), 6) AS length, round(max(value / norm), 6) AS most FROM v JOIN n USING (doc_id) GROUP BY v.doc_id""")
def hash_embed_unit(spark, d):
    """Embedded texts scaled to length 1: dimensions in use, length, largest component."""
    rows = vectors.unit(vectors.hash_embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")))
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("dims"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("length"), F.round(F.max("value"), 6).alias("most"))


@query("""WITH t AS (SELECT qid, list_max(c) AS r FROM (SELECT o_orderkey AS qid, [CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_custkey % 3 + 1] AS c FROM orders))
SELECT qid, (['public','internal','restricted'])[r] AS tier, r <= 2 AS allowed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at,
CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'order:' || o_orderkey END AS label FROM t JOIN orders ON o_orderkey = qid""")
def compose_tiers(spark, d):
    """The tier that an order has by its status and customer, whether a member sees it, its time and its label."""
    from weftspark.operators.graph import rank

    tiers = F.array(F.lit("public"), F.lit("internal"), F.lit("restricted"))
    own = F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "internal").otherwise("restricted")
    r = F.array_max(F.transform(F.array(own, F.element_at(tiers, (F.col("o_custkey") % 3 + 1).cast("int"))), rank))
    title = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    label = Q.label(title, name, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.element_at(tiers, r).alias("tier"), (r <= 2).alias("allowed"), Q.date_time(F.col("o_orderdate")).alias("at"), label.alias("label"))


@query(r"""SELECT 'sig:' || CASE WHEN s LIKE 'sig-%' THEN s ELSE 'sig-' || s END AS sig, 'subproject:' || CASE WHEN s LIKE 'sig-%' THEN s ELSE 'sig-' || s END || '/' || b AS subproject, p_partkey AS key
FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN 'SIG ' ELSE ' ' END || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s,
regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM part)""")
def group_ids(spark, d):
    """Ids of groups and of what they hold, from names with and without their prefix."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "SIG ").otherwise(" "), "p_type", F.lit("!"))
    sub = F.concat(F.lit("subproject:"), F.substr(T.sig_id(name), F.lit(5)), F.lit("/"), T.slug(F.col("p_brand")))
    return table(spark, d, "part").select(T.sig_id(name).alias("sig"), sub.alias("subproject"), F.col("p_partkey").alias("key"))
