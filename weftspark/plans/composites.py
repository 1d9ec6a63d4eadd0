"""Registered queries that compose several operators: hybrid and global retrieval, grounding, binding and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import graph, grounding, hybrid, vectors
from weftspark.operators.meeting import meet
from weftspark.plans.catalog import _V_SQL, ORACLES, QUERIES, _graph, _rounded, _vectors, query
from weftspark.sources import graph as src
from weftspark.sources.graph import PG_SQL, QUADS_SQL, table

__all__ = ["ORACLES", "QUERIES"]

_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s)"


def _owner(column: str = "chunk_id"):
    return src.node_id("nation", F.col(column) % 25)


@query(_V_SQL + ", " + _TOP.replace("FROM s", "FROM s WHERE label % 2 = qid // 20 % 2") + " SELECT qid, rank, chunk_id, label, round(score, 6) AS score FROM top WHERE rank <= 10")
def search_typed(spark, d):
    """The ten nearest of the question's types, with the type that a hit has."""
    asked, chunks = _vectors(spark, d)
    odd = F.floor(F.col("qid") / 20) % 2
    wanted = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i * 2 + odd).cast("int"))
    found = vectors.knn(asked.withColumn("wanted", wanted), chunks, 10, extra=["label"])
    return found.select("qid", "rank", "chunk_id", "label", F.round("score", 6).alias("score"))


def _seed_tables(spark, d):
    """Seeds of each question: a nation it names, and the owners of its five nearest chunks."""
    asked, chunks = _vectors(spark, d)
    nation = F.floor(F.col("qid") / 20) % 9 * 3
    named = asked.select(F.col("qid").cast("long").alias("qid"), src.node_id("nation", nation).alias("id"), F.lit(1).alias("pos"))
    near = vectors.knn(asked, chunks, 5)
    return named, near.select(F.col("qid").cast("long").alias("qid"), _owner().alias("id"), F.col("rank").alias("pos"))


_SEED_SQL = f"""{PG_SQL}, {_V_SQL.removeprefix('WITH ')}, {_TOP},
named AS (SELECT qid::BIGINT AS qid, 'nation:' || (qid // 20 % 9 * 3) AS id FROM q),
near AS (SELECT qid::BIGINT AS qid, 'nation:' || (chunk_id % 25) AS id, rank FROM top WHERE rank <= 5)"""


def _hybrid_sql(limit: int) -> str:
    seeds = f"""seeds AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY source, pos, id) AS n FROM (
      SELECT qid, id, min(source) AS source, min_by(pos, source * 1000 + pos) AS pos FROM (
        SELECT qid, id, 0 AS source, 1 AS pos FROM named JOIN ranked rk USING (id) WHERE rk.r <= {limit} UNION ALL SELECT qid, id, 1, rank FROM near) GROUP BY qid, id)) WHERE n <= 8)"""
    return f"""WITH {_SEED_SQL}, {seeds},
    e AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM (SELECT DISTINCT src, dst FROM adj WHERE r <= {limit})) WHERE n <= 8 + 2 * 50),
    sd AS MATERIALIZED (SELECT qid, id FROM seeds),
    h1 AS MATERIALIZED (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (
      SELECT DISTINCT s.qid, e.dst AS id FROM sd s JOIN e ON e.src = s.id) c WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.qid = c.qid AND x.id = c.id)) WHERE n <= 50),
    h2 AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (
      SELECT DISTINCT h1.qid, e.dst AS id FROM h1 JOIN e ON e.src = h1.id) c
      WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.qid = c.qid AND x.id = c.id) AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.qid = c.qid AND x.id = c.id)) WHERE n <= 50),
    a AS (SELECT qid, id, 0 AS hop FROM sd UNION ALL SELECT qid, id, 1 FROM h1 UNION ALL SELECT qid, id, 2 FROM h2)
    SELECT qid, id, hop FROM a JOIN ranked rk USING (id) WHERE rk.r <= {limit}"""


@query(_hybrid_sql(3))
def hybrid_seed_expand(spark, d):
    nodes, _, adj = _graph(spark, d)
    return hybrid.seed_and_expand(*_seed_tables(spark, d), nodes, adj).select("qid", "id", "hop")


@query(_hybrid_sql(2))
def hybrid_clearance(spark, d):
    nodes, _, adj = _graph(spark, d)
    return hybrid.seed_and_expand(*_seed_tables(spark, d), nodes, adj, clearance=2).select("qid", "id", "hop")


@query(f"SELECT mode, qid, count(*) AS n FROM (SELECT 'hybrid' AS mode, qid, id FROM ({_hybrid_sql(3)}) UNION ALL "
       f"SELECT 'vector', qid, id FROM (WITH {_SEED_SQL} SELECT DISTINCT qid, id FROM near) UNION ALL "
       f"SELECT 'graph', qid, dst FROM (WITH {_SEED_SQL} SELECT DISTINCT qid, dst FROM named JOIN adj ON adj.src = named.id)) GROUP BY mode, qid")  # fmt: skip
def compare_modes(spark, d):
    """How many nodes each question gets from vectors alone, from the graph alone, and from both."""
    nodes, _, adj = _graph(spark, d)
    named, near = _seed_tables(spark, d)
    both = hybrid.seed_and_expand(named, near, nodes, adj).select(F.lit("hybrid").alias("mode"), "qid", "id")
    alone = near.select(F.lit("vector").alias("mode"), "qid", "id").distinct()
    asked, met = graph.linked(named, adj)
    linked = asked.join(met.groupBy("ids").agg(F.count("*").alias("n")), "ids").select(F.lit("graph").alias("mode"), "qid", "n")
    return both.unionByName(alone).groupBy("mode", "qid").agg(F.count("*").alias("n")).unionByName(linked)


_ROWS_SQL = (f"SELECT 'hybrid' AS mode, qid, id FROM ({_hybrid_sql(3)}) UNION ALL SELECT 'vector', qid, id FROM (WITH {_SEED_SQL} SELECT DISTINCT qid, id FROM near) UNION ALL "
             f"SELECT 'graph', qid, dst FROM (WITH {_SEED_SQL} SELECT DISTINCT qid, dst FROM named JOIN adj ON adj.src = named.id)")  # fmt: skip


@query(_ROWS_SQL)
def mode_rows(spark, d):
    """The nodes that each question gets by each mode."""
    nodes, _, adj = _graph(spark, d)
    named, near = _seed_tables(spark, d)
    both = hybrid.seed_and_expand(named, near, nodes, adj).select(F.lit("hybrid").alias("mode"), "qid", "id")
    alone = near.select(F.lit("vector").alias("mode"), "qid", "id").distinct()
    linked = meet(*graph.linked(named, adj), ["ids"]).select(F.lit("graph").alias("mode"), "qid", "id")
    return both.unionByName(alone).unionByName(linked)


@query(_hybrid_sql(2).replace("AS rank FROM s)", "AS rank FROM s WHERE r <= 2 AND label IN (ql, (ql + 1) % 10))"))
def selfquery_hybrid(spark, d):
    """Hybrid retrieval whose near chunks pass the question's own filter and a member's clearance."""
    nodes, _, adj = _graph(spark, d)
    asked, chunks = _vectors(spark, d)
    named = _seed_tables(spark, d)[0]
    asked = asked.withColumn("wanted", F.array(F.col("ql"), (F.col("ql") + 1) % 10)).withColumn("clearance", F.lit(2))
    near = vectors.knn(asked, chunks, 5).select(F.col("qid").cast("long").alias("qid"), _owner().alias("id"), F.col("rank").alias("pos"))
    return hybrid.seed_and_expand(named, near, nodes, adj, clearance=2).select("qid", "id", "hop")


_COMMUNITY_SQL = f"""{PG_SQL}, com AS (SELECT e.dst AS community, count(*) AS size, max(k.r) AS r FROM edges e JOIN ranked k ON k.id = e.src WHERE e.kind = 'IN_NATION' GROUP BY e.dst),
asked AS (SELECT DISTINCT conv_id AS qid, conv_id % 3 + 1 AS level FROM conversations),
served AS (SELECT qid, community, size, rank FROM (SELECT l.level, c.community, c.size, row_number() OVER (PARTITION BY l.level ORDER BY c.size DESC, c.community) AS rank
  FROM (SELECT DISTINCT level FROM asked) l JOIN com c ON c.r <= l.level) JOIN asked USING (level) WHERE rank <= 16)"""


def _served(spark, d):
    nodes, edges = src.nodes(spark, d), src.edges(spark, d)
    member = edges.where("kind = 'IN_NATION'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
    sized = member.join(nodes.select("id", graph.rank(F.col("tier")).alias("r")), "id").groupBy("community").agg(F.count("*").alias("size"), F.max("r").alias("r"))
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), (F.col("conv_id") % 3 + 1).alias("r")).distinct()
    return hybrid.served(sized, asked)


@query(f"WITH {_COMMUNITY_SQL} SELECT qid, community, size, rank FROM served")
def community_gate(spark, d):
    return _served(spark, d)


@query(f"""WITH {_COMMUNITY_SQL}, v AS (SELECT qid, rank, CASE WHEN size % 2 = qid % 2 THEN 'NOT RELEVANT' ELSE community || ' has ' || size END AS answer FROM served)
SELECT qid, CASE WHEN count(*) FILTER (WHERE answer <> 'NOT RELEVANT') = 0 THEN 'No community is relevant.' ELSE string_agg(answer, chr(10) ORDER BY rank) FILTER (WHERE answer <> 'NOT RELEVANT') END AS answer,
count(*) FILTER (WHERE answer <> 'NOT RELEVANT') AS n FROM v GROUP BY qid""")
def global_map_reduce(spark, d):
    told = F.when(F.col("size") % 2 == F.col("qid") % 2, " NOT RELEVANT ").otherwise(F.concat("community", F.lit(" has "), F.col("size").cast("string")))
    return hybrid.reduce_verdicts(_served(spark, d).withColumn("answer", told))


#: Edge kinds with the kinds of their ends; OWNS has none on purpose.
SCHEMA = [("CONTAINS", "order", "part"), ("SUPPLIES", "supplier", "part"), ("OWNS", None, None)]


def _candidates(spark, d):
    """Claims that lines make, of each order about a part: some broken, some written otherwise than the nodes."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    m = key % 7
    predicate = F.when(m == 1, "contains").when(m == 2, "KNOWS").when(m == 3, "OWNS").otherwise("CONTAINS")
    subject = F.when(m == 4, " ").when(m == 5, F.concat(F.lit(" ORDER:"), F.col("l_orderkey").cast("string"))).otherwise(src.node_id("order", F.col("l_orderkey")))
    target = src.node_id("part", F.col("l_partkey") + F.when(m == 6, 1_000_000_000).otherwise(0))
    return lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cid"), subject.alias("subject"), predicate.alias("predicate"), target.alias("object"))


def _verdicts(spark, d):
    schema = spark.createDataFrame(SCHEMA, "predicate string, src_kind string, dst_kind string")
    return grounding.triple_verdicts(_candidates(spark, d), schema)


_CLAIM_SQL = """claims AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cid, l_orderkey AS o, l_partkey AS p, (l_orderkey * 10 + l_linenumber) % 7 AS m FROM lineitem),
judged AS (SELECT *, CASE m WHEN 4 THEN 'empty-subject' WHEN 1 THEN 'malformed-predicate' WHEN 2 THEN 'off-schema-predicate' WHEN 3 THEN 'unknown-endpoint-kind' END AS rule FROM claims)"""


@query(f"WITH {_CLAIM_SQL} SELECT cid, rule FROM judged")
def validate_triples(spark, d):
    return _verdicts(spark, d).select("cid", "rule")


@query(f"WITH {_CLAIM_SQL} SELECT cid, 'order:' || o AS src, 'part:' || p AS dst FROM judged WHERE rule IS NULL AND m <> 6 AND o IN (SELECT o_orderkey FROM orders) AND p IN (SELECT p_partkey FROM part)")
def ground_triples(spark, d):
    return grounding.ground(_verdicts(spark, d).where("rule is null"), src.nodes(spark, d))


@query(f"WITH {_CLAIM_SQL} SELECT coalesce(rule, CASE WHEN m = 6 OR o NOT IN (SELECT o_orderkey FROM orders) OR p NOT IN (SELECT p_partkey FROM part) THEN 'ungrounded' ELSE 'accepted' END) AS verdict, count(*) AS n FROM judged GROUP BY ALL")
def verdict_counts(spark, d):
    judged = _verdicts(spark, d)
    held = grounding.ground(judged.where("rule is null"), src.nodes(spark, d)).select("cid", F.lit("accepted").alias("accepted"))
    verdict = F.coalesce("rule", "accepted", F.lit("ungrounded"))
    return judged.select("cid", "rule").join(held, "cid", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS rid, n::INT AS n, 'user:' || user_id AS subject, 'DID' AS predicate, event_type || n AS object
FROM events, unnest(range(event_id % 3 + 1)) AS t(n) WHERE event_id % 4 <> 3""")
def parse_replies(spark, d):
    """Replies of a batch model about events: plain, fenced, with words around, or cut off."""
    one = F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3), lambda i: F.to_json(F.struct(
        src.node_id("user", F.col("user_id")).alias("subject"), F.lit("DID").alias("predicate"), F.concat("event_type", i.cast("string")).alias("object"))))
    body = F.concat(F.lit("["), F.array_join(one, ","), F.lit("]"))
    m = F.col("event_id") % 4
    reply = F.when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here: "), body)).when(m == 3, F.substring(body, 1, 9)).otherwise(body)
    return grounding.reply_triples(table(spark, d, "events").select(F.col("event_id").alias("rid"), reply.alias("reply")))


@query("""SELECT event_type, decided_by, decision, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'model' ELSE 'rule' END AS decided_by,
CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'hybrid_graph' END AS decision FROM events) GROUP BY ALL""")
def validate_decisions(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("event_type").alias("proposed"), F.lit("hybrid_graph").alias("fallback"))
    return grounding.checked_decisions(rows, ["click", "view", "purchase"]).groupBy("event_type", "decided_by", "decision").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, round(count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) * 1.0 / count(*), 6)::DOUBLE AS share FROM events GROUP BY 1")
def route_fraction(spark, d):
    """The share of each day's decisions that the model took."""
    rows = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("proposed"), F.lit("hybrid_graph").alias("fallback"))
    taken = grounding.checked_decisions(rows, ["click", "view", "purchase"])
    return taken.groupBy("day").agg(F.round(F.count_if(F.col("decided_by") == "model") / F.count("*"), 6).alias("share"))


@query(_V_SQL + ", " + _TOP + """ SELECT qid, left(string_agg('[' || label || '] chunk ' || chunk_id, chr(10) ORDER BY rank), 24000) AS context FROM top WHERE rank <= 10 GROUP BY qid""")
def context_text(spark, d):
    hits = vectors.knn(*_vectors(spark, d), 10, extra=["label"])
    body = F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))
    return grounding.contexts(hits.select("qid", "rank", F.col("label").cast("string").alias("label"), body.alias("body")))


@query(f"""WITH {QUADS_SQL}, l AS (SELECT s, p, o, o_type FROM quads), n AS (SELECT s AS id, p, o AS other, o_type <> 'iri' AS leaf FROM l UNION SELECT o, p, s, false FROM l WHERE o_type = 'iri')
SELECT id, p, count(*) AS n, count(*) FILTER (WHERE leaf) AS leaves FROM n GROUP BY id, p""")
def search_graph(spark, d):
    """Both directions of every triple: what each subject and each IRI is linked with; literals are leaves."""
    rows = src.quads(spark, d)
    out = rows.select(F.col("s").alias("id"), "p", F.col("o").alias("other"), (F.col("o_type") != "iri").alias("leaf"))
    back = rows.where("o_type = 'iri'").select(F.col("o").alias("id"), "p", F.col("s").alias("other"), F.lit(False).alias("leaf"))
    return out.union(back).distinct().groupBy("id", "p").agg(F.count("*").alias("n"), F.count_if("leaf").alias("leaves"))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'mutation' WHEN 1 THEN 'service' WHEN 2 THEN 'not_select' WHEN 3 THEN 'no_from_named'
WHEN 4 THEN 'unbounded_path' ELSE 'ok' END AS verdict FROM events) GROUP BY verdict""")
def screen_sparql(spark, d):
    kind = F.col("event_type")
    named = F.concat(F.lit("SELECT ?s FROM NAMED <urn:g> WHERE { ?s a <urn:"), kind, F.lit("> }"))
    logged = [
        F.concat(F.lit("DELETE WHERE { ?s a <urn:"), kind, F.lit("> }")), F.concat(F.lit("SELECT ?s FROM NAMED <urn:g> WHERE { SERVICE <urn:"), kind, F.lit("> { } }")),
        F.concat(F.lit("ASK { ?s a <urn:"), kind, F.lit("> }")), F.concat(F.lit("SELECT ?s WHERE { ?s a <urn:"), kind, F.lit("> }")),
        F.concat(F.lit("SELECT ?s FROM NAMED <urn:g> WHERE { ?s <urn:"), kind, F.lit(">+ ?o }")), named,
    ]
    text = F.element_at(F.array(*logged), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select(T.screened_sparql(text).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))
