"""Registered queries of ingest runs: full, incremental, staged, their state and reports, chunks by parent, schema-guided edges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from weftspark.functions import text as T
from weftspark.operators import ingest, state, vectors
from weftspark.operators.store import Artifacts, Store
from weftspark.plans.catalog import ORACLES, QUERIES, query
from weftspark.plans.composites import _CLAIM_SQL, _candidates, _verdicts
from weftspark.sources import graph, ledger
from weftspark.sources.graph import table
from weftspark.sources.ledger import LEDGER_SQL, said_sql

__all__ = ["ORACLES", "QUERIES"]

_SOURCES = "list_sort(list(DISTINCT split_part(doc, '/', 1)))"
_FULL = f"""{{name}}_nodes AS (SELECT id, min(kind) AS kind, count(DISTINCT doc) AS n_docs, array_to_string({_SOURCES}, ',') AS sources, arg_min(title, doc) FILTER (WHERE title IS NOT NULL) AS title FROM {{name}}_n GROUP BY id),
{{name}}_edges AS (SELECT src, kind, dst, count(DISTINCT doc) AS n_docs FROM {{name}}_e GROUP BY src, kind, dst)"""
_TIER = "(['public','internal','restricted'])"
_RANK = "(CASE WHEN {c} LIKE 'kep-%' AND substr({c}, 5)::BIGINT < 10000000 THEN substr({c}, 5)::BIGINT % 3 ELSE 0 END)"


def _run_sql(name: str, of: str) -> str:
    return f"{said_sql(name, of)}, {_FULL.format(name=name)}"


def _flat(nodes):
    return nodes.select("id", "kind", F.size("docs").cast("long").alias("n_docs"), F.array_join("sources", ",").alias("sources"), F.col("props")["title"].alias("title"))


@query(f"WITH {LEDGER_SQL}, {_run_sql('a', 'was')} SELECT id, kind, n_docs, sources, title, {_TIER}[{_RANK.format(c='id')} + 1] AS tier FROM a_nodes")
def ingest_full(spark, d):
    """The nodes of the whole corpus with their documents, sources, first title and tier."""
    nodes, _ = ingest.full(ledger.before(spark, d), ledger.extract, ledger.labels(spark, d))
    return _flat(nodes).join(nodes.select("id", "tier"), "id")


@query(f"WITH {LEDGER_SQL}, {_run_sql('a', 'was')} SELECT src, kind, dst, n_docs, {_TIER}[greatest({_RANK.format(c='src')}, {_RANK.format(c='dst')}) + 1] AS tier FROM a_edges")
def ingest_full_edges(spark, d):
    _, edges = ingest.full(ledger.before(spark, d), ledger.extract, ledger.labels(spark, d))
    return edges.select("src", "kind", "dst", F.size("docs").cast("long").alias("n_docs"), "tier")


@query(f"""WITH {LEDGER_SQL}, {_run_sql('a', 'was')} SELECT 'node' AS what, kind, count(*) AS n FROM a_nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM a_edges GROUP BY kind
UNION ALL SELECT 'document', kind, count(*) FROM was GROUP BY kind UNION ALL SELECT 'merge', kind, count(*) FROM a_nodes WHERE sources LIKE '%,%' GROUP BY kind""")
def ingest_run_report(spark, d):
    docs = ledger.before(spark, d)
    return ingest.report(*ingest.full(docs, ledger.extract, ledger.labels(spark, d)), docs)


def _change(spark, d):
    was = state.settle(ledger.hashed(ledger.before(spark, d)))
    now = state.settle(ledger.hashed(ledger.after(was.drop("hash"))))
    return was, now, ingest.Delta(was.select("doc_id", "hash"), now.select("doc_id", "hash"))


def _delta(spark, d):
    was, now, change = _change(spark, d)
    store = ledger.extract(was)
    return was, now, change, store, ingest.incremental(store, now, change, ledger.extract)


#: The stores that this process has made: an ingested corpus for each application and folder of tables.
_STORES: dict[tuple[str, str], Store] = {}


def stored(spark, d):
    """(store, version) of the corpus before any change, ingested once; what is done to it later is not committed."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = Store(spark, state.new_folder(spark, "store"), ingest.TABLES)
        ingest.ingest(store, ledger.hashed(ledger.before(spark, d)), ledger.extract)
        _STORES[key] = store
    return _STORES[key], 1


def _maintained(spark, d, divisors):
    store, version = stored(spark, d)
    return ingest.Maintained(store, ledger.hashed(ledger.after(ledger.before(spark, d), divisors)), ledger.extract, version)


_NODES = f"{_run_sql('b', 'now')} SELECT id, kind, n_docs, sources FROM b_nodes"
_EDGES = f"{_run_sql('b', 'now')} SELECT src, kind, dst, n_docs FROM b_edges"


def _node_rows(nodes):
    return nodes.select("id", "kind", F.size("docs").cast("long").alias("n_docs"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {LEDGER_SQL}, {_NODES}")
def ingest_delta(spark, d):
    """The nodes after an incremental run over a stored corpus of which a quarter changes, which are those of a rebuild."""
    return _node_rows(_maintained(spark, d, ledger.LARGE).after("nodes"))


@query(f"WITH {LEDGER_SQL}, {_EDGES}")
def ingest_delta_edges(spark, d):
    edges = _maintained(spark, d, ledger.LARGE).after("edges")
    return edges.select("src", "kind", "dst", F.size("docs").cast("long").alias("n_docs"))


@query(f"WITH {ledger.ledger_sql(ledger.SMALL)}, {_NODES}")
def ingest_small_delta(spark, d):
    """The same where a twentieth changes."""
    return _node_rows(_maintained(spark, d, ledger.SMALL).after("nodes"))


@query(f"WITH {ledger.ledger_sql(ledger.SMALL)}, {_EDGES}")
def ingest_small_delta_edges(spark, d):
    edges = _maintained(spark, d, ledger.SMALL).after("edges")
    return edges.select("src", "kind", "dst", F.size("docs").cast("long").alias("n_docs"))


@query(f"""WITH {ledger.ledger_sql(ledger.SMALL)}, {_run_sql('a', 'was')}, {_run_sql('b', 'now')},
drop_ AS (SELECT w.doc_id FROM was w LEFT JOIN now n USING (doc_id) WHERE n.doc_id IS NULL OR (w.title, w.owner, w.authors) IS DISTINCT FROM (n.title, n.owner, n.authors)),
read_ AS (SELECT n.doc_id FROM now n LEFT JOIN was w USING (doc_id) WHERE w.doc_id IS NULL OR (w.title, w.owner, w.authors) IS DISTINCT FROM (n.title, n.owner, n.authors)),
tn AS (SELECT id FROM a_n JOIN drop_ ON doc = doc_id UNION SELECT id FROM b_n JOIN read_ ON doc = doc_id), te AS (SELECT src, kind, dst FROM a_e JOIN drop_ ON doc = doc_id UNION SELECT src, kind, dst FROM b_e JOIN read_ ON doc = doc_id)
SELECT 'nodes_gained' AS what, count(*) AS n FROM tn JOIN b_nodes USING (id) UNION ALL SELECT 'nodes_lost', count(*) FROM tn WHERE id NOT IN (SELECT id FROM b_nodes) UNION ALL SELECT 'nodes_held', count(*) FROM a_nodes
UNION ALL SELECT 'edges_gained', count(*) FROM te JOIN b_edges USING (src, kind, dst) UNION ALL SELECT 'edges_lost', count(*) FROM te WHERE NOT EXISTS (SELECT 1 FROM b_edges b WHERE b.src = te.src AND b.kind = te.kind AND b.dst = te.dst)
UNION ALL SELECT 'edges_held', count(*) FROM a_edges""")
def ingest_small_delta_cost(spark, d):
    """How many nodes and edges that run writes and deletes, beside those that the store holds."""
    return _maintained(spark, d, ledger.SMALL).report().where(F.col("what").contains("_"))


_CHANGE_SQL = """o AS (SELECT w.doc_id, n.doc_id IS NULL AS gone, n.doc_id IS NOT NULL AND (w.title <> n.title OR w.owner IS DISTINCT FROM n.owner OR w.authors <> n.authors) AS edited FROM was w LEFT JOIN now n ON n.doc_id = w.doc_id),
fresh AS (SELECT * FROM now WHERE doc_id NOT IN (SELECT doc_id FROM was) OR doc_id IN (SELECT doc_id FROM o WHERE edited)), dropped AS (SELECT doc_id FROM o WHERE gone OR edited)"""


@query(f"""WITH {LEDGER_SQL}, {_CHANGE_SQL}, {_run_sql('a', 'was')}, {said_sql('f', 'fresh')}, live AS (SELECT id, doc FROM a_n WHERE doc NOT IN (SELECT doc_id FROM dropped) UNION SELECT id, doc FROM f_n),
hit AS (SELECT id FROM a_n WHERE doc IN (SELECT doc_id FROM dropped) UNION SELECT id FROM f_n),
t AS (SELECT h.id, (SELECT list_sort(list(DISTINCT doc)) FROM live l WHERE l.id = h.id) AS docs, (SELECT list_sort(list(DISTINCT doc)) FROM a_n a WHERE a.id = h.id) AS had,
  (SELECT max(title) FROM a_n a WHERE a.id = h.id) AS was_title, (SELECT max(title) FROM f_n f WHERE f.id = h.id) AS now_title FROM hit h)
SELECT id, CASE WHEN docs IS NULL THEN 'delete' ELSE 'upsert' END AS action, coalesce(now_title, was_title) AS title, coalesce(len(docs), 0)::BIGINT AS n_docs FROM t
WHERE docs IS NULL OR docs IS DISTINCT FROM had OR (now_title IS NOT NULL AND now_title IS DISTINCT FROM was_title)""")
def node_plan(spark, d):
    """What an incremental run does to nodes: deleted without documents, upserted where documents or properties change."""
    plan = _delta(spark, d)[4][2]
    return plan.select("id", "action", F.col("props")["title"].alias("title"), F.coalesce(F.size("docs"), F.lit(0)).cast("long").alias("n_docs"))


@query(f"""WITH {LEDGER_SQL}, {_CHANGE_SQL}, {_run_sql('a', 'was')}, {_run_sql('b', 'now')}, moved AS (SELECT doc_id FROM was WHERE kind = 'kep' AND key % 13 = 0 AND key % 17 <> 0 AND key % 11 <> 0),
gone AS (SELECT id FROM a_nodes WHERE id NOT IN (SELECT id FROM b_nodes)), ge AS (SELECT src, dst FROM a_edges a WHERE NOT EXISTS (SELECT 1 FROM b_edges b WHERE b.src = a.src AND b.kind = a.kind AND b.dst = a.dst)),
c AS (SELECT 'moved' AS what, count(*) AS n FROM moved UNION ALL SELECT 'changed', count(*) FROM o WHERE edited
  UNION ALL SELECT 'deleted', (SELECT count(*) FROM o WHERE gone) - (SELECT count(*) FROM moved) UNION ALL SELECT 'added', (SELECT count(*) FROM now WHERE doc_id NOT IN (SELECT doc_id FROM was)) - (SELECT count(*) FROM moved))
SELECT * FROM c WHERE n > 0 UNION ALL SELECT 'nodes_before', count(*) FROM a_nodes UNION ALL SELECT 'edges_before', count(*) FROM a_edges UNION ALL SELECT 'chunks_before', count(*) FROM was
UNION ALL SELECT 'nodes_after', count(*) FROM b_nodes UNION ALL SELECT 'edges_after', count(*) FROM b_edges UNION ALL SELECT 'chunks_after', count(*) FROM now
UNION ALL SELECT 'orphans', (SELECT count(*) FROM gone) + (SELECT count(*) FROM ge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) UNION ALL SELECT 'embedded', count(*) FROM fresh""")
def ingest_delta_report(spark, d):
    was, now, change, store, (nodes, edges, node_plan_, edge_plan) = _delta(spark, d)
    chunk = lambda df: df.select("doc_id", F.col("title").alias("text"))
    index, written = ingest.chunk_delta(chunk(was), chunk(now), change)
    return ingest.delta_report(store, (nodes, edges), (node_plan_, edge_plan), change, (chunk(was), index), written)


_FP = "a1b2c3d4e5f60718"


@query(f"""WITH {LEDGER_SQL}, h AS (SELECT doc_id, key, kind, sha256(concat_ws('|', kind, key, title, coalesce(owner::VARCHAR, '-'), array_to_string(authors, ','))) AS hash FROM now),
w AS (SELECT doc_id, key, sha256(concat_ws('|', kind, key, title, coalesce(owner::VARCHAR, '-'), array_to_string(authors, ','))) AS hash FROM was)
SELECT h.doc_id, CASE WHEN h.hash IN (SELECT hash FROM w WHERE key % 5 <> 0) THEN 'cached' ELSE 'embed' END AS work, 'silver/{_FP}/' || h.hash || '/chunks' AS silver_chunks, 'gold' AS stage,
CASE WHEN w.hash = h.hash AND w.key % 2 = 0 THEN 'silver/ff/' || w.hash || '/candidates' END AS silver_candidates FROM h LEFT JOIN w ON w.doc_id = h.doc_id""")
def ingest_staged(spark, d):
    """Which documents' chunks come from the cache, moved ones too, and the state that the run leaves."""
    was, now = ledger.hashed(ledger.before(spark, d)), ledger.hashed(ledger.after(ledger.before(spark, d)))
    cache = was.where("key % 5 <> 0").select(F.lit(_FP).alias("fp"), "hash")
    old = was.select("doc_id", F.col("hash").alias("content_hash"), F.when(F.col("key") % 2 == 0, F.concat(F.lit("silver/ff/"), "hash", F.lit("/candidates"))).alias("silver_candidates"))
    work, after = ingest.staged(now.select("doc_id", "hash"), cache, old, _FP)
    return work.select("doc_id", "work").join(after.select("doc_id", "silver_chunks", "stage", "silver_candidates"), "doc_id")


PIECE = T_.StructType([T_.StructField("text", T_.StringType()), T_.StructField("v", T_.ArrayType(T_.DoubleType()))])


def _embed(docs):
    """Windows of the texts of documents (hash, text) with the vectors of their words."""
    rows = T.windows(docs.select(F.col("hash").alias("doc_id"), "text")).withColumnRenamed("doc_id", "hash")
    return vectors.embedded(rows, ["hash", "ordinal", "text"])


@query(r"""WITH p AS (SELECT DISTINCT source, doc_id, text, CASE WHEN doc_id % 7 = 0 THEN '-moved' ELSE '' END AS moved FROM documents WHERE text IS NOT NULL),
c AS (SELECT source || '/' || doc_id || moved || '#' AS stem, list_filter(list_transform(range(1, greatest(length(text), 1) + 1, 850), lambda i: substr(text, i, 1000)), lambda x: trim(x, E' \t\n\r') <> '') AS ps FROM p),
k AS (SELECT stem || (i - 1) AS chunk_id, ps[i] AS t FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM c)),
w AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(t), '[ \t\n\x0b\f\r]+')) AS w FROM k),
h AS (SELECT chunk_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 256 AS idx, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w WHERE w <> ''),
v AS (SELECT chunk_id, idx, sum(sign) AS value FROM h GROUP BY ALL HAVING sum(sign) <> 0), d AS (SELECT chunk_id, count(*) AS dims, max(abs(value)) AS most, sqrt(sum(value * value)) AS norm FROM v GROUP BY 1)
SELECT chunk_id, sha256(t) AS text_sha256, coalesce(dims, 0)::BIGINT AS dims, round(coalesce(most / norm, 0), 6)::DOUBLE AS most FROM k LEFT JOIN d USING (chunk_id)""")
def staged_chunks(spark, d):
    """The chunks of a second staged run, which embeds only what the first one, over four fifths of the documents, has not: moved ones are found by their content."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").where("text is not null").select(name.alias("doc_id"), F.col("doc_id").alias("n"), "text", F.sha2("text", 256).alias("hash"))
    store = Artifacts(spark, state.new_folder(spark, "artifacts"), PIECE)
    none = docs.limit(0).select("doc_id", F.col("hash").alias("content_hash"), F.lit("gold").alias("stage"), F.lit("").alias("silver_chunks"), F.lit("").alias("silver_candidates"))
    ingest.staged_run(docs.where("n % 5 <> 0"), none, store, _FP, _embed)
    now = docs.withColumn("doc_id", F.when(F.col("n") % 7 == 0, F.concat("doc_id", F.lit("-moved"))).otherwise(F.col("doc_id")))
    found = ingest.staged_run(now, none, store, _FP, _embed)["chunks"]
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return found.select("chunk_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("dims"), F.round(most, 6).alias("most"))


@query("""SELECT 'doc-' || doc_id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'h' || doc_id END AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'bronze' WHEN doc_id % 3 = 1 THEN 'silver' ELSE 'bronze' END AS stage,
CASE WHEN doc_id % 3 = 1 THEN 'k' || doc_id END AS silver_chunks, NULL::VARCHAR AS silver_candidates FROM documents""")
def upgraded_state(spark, d):
    """States of both versions read as one: bare hashes of the first, objects of the second, with and without keys."""
    key = F.col("doc_id").cast("string")
    new = F.to_json(F.struct(F.concat(F.lit("h"), key).alias("content_hash"), F.lit("silver").alias("stage"), F.concat(F.lit("k"), key).alias("silver_chunks")))
    bare = F.to_json(F.struct(F.concat(F.lit("h"), key).alias("content_hash")))
    entry = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, new).otherwise(bare)
    return state.upgraded(table(spark, d, "documents").select(F.concat(F.lit("doc-"), key).alias("doc_id"), entry.alias("entry")))


_SECTIONS = "source || '/docs/' || doc_id"


@query(f"""WITH c AS (SELECT {_SECTIONS} AS parent_id, source, doc_id, text, CASE WHEN length(text) <= 1000 THEN [text] ELSE list_transform(range(1, length(text) + 1, 850), lambda i: substr(text, i, 1000)) END AS p
  FROM (SELECT doc_id, source, trim(text, E' \\t\\n\\r') AS text FROM documents) WHERE text <> ''), k AS (SELECT parent_id, source, doc_id, text, list_filter(p, lambda x: trim(x, E' \\t\\n\\r') <> '') AS p FROM c)
SELECT parent_id, source, len(p)::BIGINT AS n_children, sha256(text) AS body_sha256, parent_id || '#0' AS first_child, {_TIER}[doc_id % 3 + 1] AS tier FROM k WHERE NOT regexp_matches(text, '(?m)^\\s*#')""")
def parent_documents(spark, d):
    """Chunks grouped under their documents, in order, with the document's text."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/docs/"), F.col("doc_id").cast("string")).alias("parent_id"), "doc_id", T.stripped(F.col("text")).alias("text"))
    docs = docs.where("text <> '' and not text rlike r'(?m)^\\s*#'")
    cut = T.section_chunks(docs, ["parent_id", "doc_id"])
    chunks = cut.select(F.concat("parent_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "heading", "text", graph.tier_of(F.col("doc_id")).alias("tier"))
    found = ingest.parents(chunks, docs.select("parent_id", F.col("text").alias("body")))
    first = F.get("children", 0)["chunk_id"]
    return found.select("parent_id", "source", F.size("children").cast("long").alias("n_children"), F.sha2("body", 256).alias("body_sha256"), first.alias("first_child"), "tier")


@query(f"""WITH {_CLAIM_SQL}, line AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cid, min(l_shipdate)::DATE::VARCHAR AS doc FROM lineitem GROUP BY 1)
SELECT 'order:' || o AS src, 'CONTAINS' AS kind, 'part:' || p AS dst, 'schema-guided-llm' AS extraction_method, doc AS source_doc, 'line ' || cid AS span FROM judged JOIN line USING (cid)
WHERE rule IS NULL AND m <> 6 AND o IN (SELECT o_orderkey FROM orders) AND p IN (SELECT p_partkey FROM part)""")
def schema_edges(spark, d):
    """Edges from claims that pass validation and are grounded, with how they were found, their document and words."""
    from weftspark.operators import grounding

    lines = table(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cid")).agg(F.min("l_shipdate").alias("at"))
    said = lines.select("cid", F.to_date("at").cast("string").alias("doc"), F.concat(F.lit("line "), "cid").alias("span"))
    judged = _verdicts(spark, d)
    held = grounding.ground(judged.where("rule is null"), graph.nodes(spark, d))
    return ingest.schema_edges(said.join(_candidates(spark, d).select("cid"), "cid", "left_semi"), judged, held)[0]


@query(f"""WITH {_CLAIM_SQL}, line AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cid, min(l_shipdate)::DATE::VARCHAR AS doc FROM lineitem GROUP BY 1)
SELECT cid, coalesce(rule, CASE WHEN m <> 6 AND o IN (SELECT o_orderkey FROM orders) AND p IN (SELECT p_partkey FROM part) THEN 'accepted' ELSE 'ungrounded' END) AS verdict, doc, 'line ' || cid AS span FROM judged JOIN line USING (cid)""")
def extraction_traces(spark, d):
    """The trace of every claim: which rule it broke, that it is not grounded, or that it was accepted."""
    from weftspark.operators import grounding

    lines = table(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cid")).agg(F.min("l_shipdate").alias("at"))
    said = lines.select("cid", F.to_date("at").cast("string").alias("doc"), F.concat(F.lit("line "), "cid").alias("span"))
    judged = _verdicts(spark, d)
    held = grounding.ground(judged.where("rule is null"), graph.nodes(spark, d))
    return ingest.schema_edges(said.join(_candidates(spark, d).select("cid"), "cid", "left_semi"), judged, held)[1]


@query("""WITH c AS (SELECT vec_id AS chunk_id, (['a', 'b'])[vec_id % 2 + 1] AS source, vec_id // 4 AS path, label FROM embeddings),
k AS (SELECT *, source = 'b' AND path % 5 = 0 AS renewed FROM c WHERE NOT (source = 'a' AND path % 3 = 0))
SELECT min(chunk_id) AS chunk_id, source, 'p' || path AS doc_path, -1 AS label FROM k WHERE renewed GROUP BY source, path UNION ALL SELECT chunk_id, source, 'p' || path, label FROM k WHERE NOT renewed""")
def stored_chunks(spark, d):
    """A stored table of chunks after some documents were deleted by source and path together, others were indexed anew, and it was compacted."""
    store = Store(spark, state.new_folder(spark, "chunks"), {"chunks": ["source", "doc_path"]})
    path = F.floor(F.col("vec_id") / 4)
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("source"), F.concat(F.lit("p"), path.cast("string")).alias("doc_path"), "label")
    number = F.substring("doc_path", 2, 18).cast("long")
    store.commit({"chunks": chunks}, whole=True)
    store.commit(gone={"chunks": chunks.where((F.col("source") == "a") & (number % 3 == 0))})
    anew = chunks.where((F.col("source") == "b") & (number % 5 == 0)).groupBy("source", "doc_path").agg(F.min("chunk_id").alias("chunk_id"))
    store.commit({"chunks": anew.select("chunk_id", "source", "doc_path", F.lit(-1).cast(chunks.schema["label"].dataType).alias("label"))})
    store.compact("chunks")
    return store.read("chunks")


@query("SELECT vec_id AS chunk_id, (['a','b'])[vec_id % 2 + 1] AS source, 'p' || (vec_id // 4) AS doc_path FROM embeddings WHERE NOT (vec_id % 2 = 0 AND vec_id // 4 % 3 = 0)")
def delete_chunks(spark, d):
    """Chunks of a table without those of some documents, told by source and path together."""
    chunks = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("source"), F.concat(F.lit("p"), F.floor(F.col("vec_id") / 4).cast("string")).alias("doc_path")
    )
    gone = chunks.where("source = 'a' and cast(substring(doc_path, 2) as long) % 3 = 0").select("source", "doc_path")
    return ingest.deleted(chunks, gone)


@query("""SELECT id, kind, CASE WHEN k % 10 = 4 THEN 'renamed' ELSE name END AS name FROM (SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, c_name AS name, c_custkey AS k FROM customer) WHERE k % 10 <> 3
UNION ALL SELECT 'edge', 'PLACED', count(*)::VARCHAR FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 10 <> 3""")
def replace_rows(spark, d):
    """Nodes some of which are replaced exactly and some deleted with the edges at their ends."""
    nodes = graph.nodes(spark, d).where("kind = 'customer'").select("id", "kind", "name")
    edges = graph.edges(spark, d).where("kind = 'PLACED'")
    number = F.substring_index("id", ":", -1).cast("long") % 10
    fresh = nodes.where(number == 4).withColumn("name", F.lit("renamed"))
    kept, left = ingest.without_nodes(ingest.replaced(nodes, fresh, ["id"]), edges, nodes.where(number == 3))
    owned = left.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return kept.unionByName(owned.agg(F.count("*").cast("string").alias("name")).select(F.lit("edge").alias("id"), F.lit("PLACED").alias("kind"), "name"))


@query(f"""WITH {LEDGER_SQL}, {_CHANGE_SQL} SELECT doc_id, 'reads' AS what FROM fresh UNION ALL SELECT doc_id, 'drops' FROM dropped""")
def delta_documents(spark, d):
    """The documents that an incremental run reads anew, and those whose rows and chunks it drops."""
    change = _change(spark, d)[2]
    return change.read.select("doc_id", F.lit("reads").alias("what")).unionByName(change.drop.select(F.col("doc").alias("doc_id"), F.lit("drops").alias("what")))


