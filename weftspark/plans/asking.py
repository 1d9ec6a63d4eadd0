"""Registered queries of questions over the organisation graph: links, routes, filters, parameters, templates and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.operators import asking, graph
from weftspark.plans.catalog import ORACLES, QUERIES, query
from weftspark.sources import org
from weftspark.sources.graph import table
from weftspark.sources.org import ORG_SQL, QUESTIONS_SQL

__all__ = ["ORACLES", "QUERIES"]


def _one_sql(words: str, rank: int, kind: str, via: str, entity: str, drop: bool = False) -> str:
    gone = f" WHERE lower(b) NOT IN ({', '.join(repr(w) for w in Q.NO_SIG)})" if drop else ""
    return f"""SELECT qid, {rank} * 100000 + n AS pos, s AS surface, {entity} AS entity_id, '{kind}' AS kind, '{via}' AS via FROM (
      SELECT qid, generate_subscripts(l, 1) AS n, unnest(f) AS s, unnest(l) AS b FROM (SELECT qid, regexp_extract_all(question, '{words}', 0) AS f, regexp_extract_all(question, '{words}', 1) AS l FROM q)){gone}"""


_SLUG = "regexp_replace(regexp_replace(lower(b), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SIG = f"'sig:' || CASE WHEN {_SLUG} LIKE 'sig-%' THEN {_SLUG} ELSE 'sig-' || {_SLUG} END"
_MECH_SQL = f"""mech AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY qid, entity_id ORDER BY pos) AS k FROM (
  {_one_sql(Q.KEP, 0, 'kep', 'kep-number', "'kep-' || coalesce(nullif(ltrim(b, '0'), ''), '0')")}
  UNION ALL {_one_sql(Q.SIG_AFTER, 1, 'sig', 'slug', _SIG, True)} UNION ALL {_one_sql(Q.SIG_BEFORE, 2, 'sig', 'slug', _SIG, True)}
  UNION ALL {_one_sql(Q.HANDLE, 3, 'person', 'handle', "'person:' || lower(b)")})) WHERE k = 1)"""
#: Display names: only openings of the eighth kind hold any; an alias stands between word boundaries.
_LINK_SQL = f"""{QUESTIONS_SQL}, {_MECH_SQL}, named AS (SELECT qid, 900000 AS pos, lower(s_name) AS surface, 'person:supplier' || s_suppkey AS entity_id, 'person' AS kind, 'alias' AS via
  FROM q JOIN supplier ON regexp_matches(lower(question), '(^|[^a-z0-9_])' || lower(s_name) || '([^a-z0-9_]|$)')),
linked AS (SELECT * FROM mech UNION ALL SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM mech m WHERE m.qid = n.qid AND m.entity_id = n.entity_id))"""


def _cue(cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(question), '{c}')" for c in cues) + ")"


def _has(kind: str) -> str:
    return f"EXISTS (SELECT 1 FROM mech m WHERE m.qid = q.qid AND m.kind = '{kind}')"


_TEMPLATE_SQL = f"""CASE WHEN {_has('sig')} AND {_cue(['tech-lead', 'tech lead'])} THEN 'sig_tech_leads' WHEN {_has('sig')} AND {_cue(['own', 'kep'])} THEN 'sig_owned_keps'
WHEN {_has('kep')} AND {_cue(['own', 'sig'])} THEN 'kep_owning_sig' WHEN {_has('person')} AND {_cue(['sig', 'lead', 'chair'])} THEN 'person_led_sigs' WHEN {_has('sig')} THEN 'sig_owned_keps' END"""
_ENGINE_SQL = f"""CASE WHEN EXISTS (SELECT 1 FROM mech m WHERE m.qid = q.qid) THEN CASE WHEN {_cue(Q.GLOBAL_CUES)} THEN 'anchor_beats_cue' ELSE 'anchor_no_cue' END
WHEN {_cue(Q.GLOBAL_CUES)} THEN 'cue_no_anchor' ELSE 'default_local' END"""


def _linked(spark, d):
    asked = org.questions(spark, d)
    return asked, asking.link(asked, org.aliases(spark, d))


@query(f"WITH {_LINK_SQL} SELECT qid, entity_id, kind, via, surface FROM linked")
def link_entities(spark, d):
    """What each question names: proposals, groups in both word orders, handles and display names."""
    return _linked(spark, d)[1].select("qid", "entity_id", "kind", "via", "surface")


@query(f"WITH {QUESTIONS_SQL}, {_MECH_SQL}, r AS (SELECT qid, {_ENGINE_SQL} AS reason FROM q) SELECT qid, CASE reason WHEN 'cue_no_anchor' THEN 'global' ELSE 'hybrid' END AS engine, reason FROM r")
def route_engine(spark, d):
    asked = org.questions(spark, d)
    return asked.select("qid", F.inline(F.array(Q.engine(F.col("question")))))


@query(f"""WITH {QUESTIONS_SQL}, u AS (SELECT *, len(list_distinct(regexp_extract_all(question, '{Q.URI}'))) AS u FROM q)
SELECT qid, CASE WHEN {_cue(Q.AGGREGATION)} THEN 'structured' WHEN {_cue(Q.RELATION)} AND u > 0 THEN 'graph_expand' WHEN u >= 2 THEN 'ambiguous' WHEN u = 1 THEN 'hybrid_graph'
WHEN {_cue(Q.THEMATIC)} THEN 'global' ELSE 'vector_only' END AS strategy FROM u""")
def route_strategy(spark, d):
    return org.questions(spark, d).select("qid", Q.strategy(F.col("question")).alias("strategy"))


@query(f"WITH {QUESTIONS_SQL}, {_MECH_SQL} SELECT qid, {_TEMPLATE_SQL} AS template FROM q")
def select_template(spark, d):
    return org.questions(spark, d).select("qid", Q.template(F.col("question")).alias("template"))


#: Which reason each opening should be routed for, as a labelled set; 12 and the text behind an opening may add cues.
EXPECTED = ["anchor_no_cue", "anchor_no_cue", "anchor_no_cue", "anchor_no_cue", "cue_no_anchor", "cue_no_anchor", "default_local", "anchor_beats_cue", "anchor_no_cue", "default_local",
            "default_local", "anchor_no_cue", "cue_no_anchor"]


@query(f"""WITH {QUESTIONS_SQL}, {_MECH_SQL}, r AS (SELECT n, {_ENGINE_SQL} AS got FROM q)
SELECT n, count(*) AS asked, count(*) FILTER (WHERE got = ([{', '.join(repr(x) for x in EXPECTED)}])[n + 1]) AS passed FROM r GROUP BY n""")
def route_eval(spark, d):
    """How often questions are routed as their labelled opening says."""
    asked = org.questions(spark, d)
    reason = F.element_at(F.array(*[F.lit(x) for x in EXPECTED]), F.col("n") + 1)
    expected = asked.select("qid", "n", F.when(reason == "cue_no_anchor", "global").otherwise("hybrid").alias("engine"), reason.alias("reason"))
    return asking.routed(asked, expected).groupBy("n").agg(F.count("*").alias("asked"), F.count_if("passes").alias("passed"))


_RAW_SQL = f"""{_LINK_SQL}, raw AS (
  SELECT qid, 'source' AS field, 'enhancements' AS value FROM q WHERE {_cue(Q.SOURCES[0][1])} UNION ALL SELECT qid, 'source', 'community' FROM q WHERE {_cue(Q.SOURCES[1][1])}
  UNION ALL SELECT conv_id || ':' || turn, 'source', 'wiki' FROM conversations WHERE role = 'user' AND turn % 5 = 2 UNION ALL SELECT conv_id || ':' || turn, 'visibility', 'public' FROM conversations WHERE role = 'user' AND turn % 7 = 4)"""


@query(f"""WITH {_RAW_SQL} SELECT qid, field, value, CASE WHEN field <> 'source' THEN 'undeclared field' WHEN value NOT IN ('community', 'enhancements') THEN 'not in enum' END AS reason FROM raw
UNION SELECT qid, 'entity_ids', entity_id, NULL FROM linked""")
def metadata_filter(spark, d):
    """Filters that questions state, and those that the check drops with the reason."""
    asked, linked = _linked(spark, d)
    turns = table(spark, d, "conversations").where("role = 'user'")
    also = lambda where, field, value: turns.where(where).select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.lit(field).alias("field"), F.lit(9).alias("pos"), F.lit(value).alias("value"))
    raw = asking.raw_filters(linked, asked).unionByName(also("turn % 5 = 2", "source", "wiki")).unionByName(also("turn % 7 = 4", "visibility", "public"))
    return asking.checked_filters(raw, org.aliases(spark, d), ["community", "enhancements"])


@query(f"""WITH {_LINK_SQL}, f AS (SELECT conv_id || ':' || turn AS qid, 'source' AS field, 'src' || (conv_id % 20) AS value FROM conversations WHERE role = 'user' AND conv_id % 3 = 0
  UNION ALL SELECT qid, 'entity_ids', entity_id FROM linked WHERE kind = 'sig'), n AS (SELECT qid, count(DISTINCT field) AS n FROM f GROUP BY qid),
c AS (SELECT doc_id AS chunk_id, 'source' AS field, source AS value FROM documents UNION ALL SELECT doc_id, 'entity_ids', 'sig:sig-nation-' || (doc_id % 25) FROM documents UNION ALL SELECT doc_id, 'entity_ids', 'sig:sig-nation-' || (doc_id % 7) FROM documents)
SELECT f.qid, c.chunk_id FROM f JOIN c USING (field, value) JOIN n USING (qid) GROUP BY f.qid, c.chunk_id, n.n HAVING count(DISTINCT f.field) = n.n""")
def filtered_chunks(spark, d):
    """The documents that each question's filters let through: any value of a field, all of its fields."""
    linked = _linked(spark, d)[1].where("kind = 'sig'").select("qid", F.lit("entity_ids").alias("field"), F.col("entity_id").alias("value"))
    turns = table(spark, d, "conversations").where("role = 'user' and conv_id % 3 = 0")
    stated = turns.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.lit("source").alias("field"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("value"))
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    owners = F.explode(F.array(org.sig_of(F.col("chunk_id") % 25), org.sig_of(F.col("chunk_id") % 7)))
    values = docs.select("chunk_id", F.lit("source").alias("field"), F.col("source").alias("value")).unionByName(docs.select("chunk_id", F.lit("entity_ids").alias("field"), owners.alias("value")))
    return asking.matching(linked.unionByName(stated), values)


@query(f"""WITH {QUESTIONS_SQL}, u AS (SELECT *, len(list_distinct(regexp_extract_all(question, '{Q.URI}'))) AS u FROM q),
r AS (SELECT qid, CASE WHEN {_cue(Q.AGGREGATION)} THEN 'structured' WHEN {_cue(Q.RELATION)} AND u > 0 THEN 'graph_expand' WHEN u >= 2 THEN 'ambiguous' WHEN u = 1 THEN 'hybrid_graph' WHEN {_cue(Q.THEMATIC)} THEN 'global' ELSE 'vector_only' END AS s FROM u),
p AS (SELECT conv_id || ':' || turn AS qid, CASE conv_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'sql' ELSE 'vector_only' END AS p FROM conversations WHERE role = 'user')
SELECT qid, CASE WHEN s <> 'ambiguous' THEN s WHEN p = 'sql' THEN 'hybrid_graph' ELSE p END AS strategy, CASE WHEN s = 'ambiguous' AND p <> 'sql' THEN 'model' ELSE 'rule' END AS decided_by FROM r JOIN p USING (qid)""")
def decide_strategy(spark, d):
    """The strategy of each question; ambiguous ones take a proposal if it is one of the closed set."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    proposed = F.when(F.col("conv_id") % 3 == 0, "global").when(F.col("conv_id") % 3 == 1, "sql").otherwise("vector_only")
    return asking.decided(org.questions(spark, d), turns.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), proposed.alias("proposed")))


@query(f"""WITH {QUESTIONS_SQL}, i AS (SELECT qid, list_filter(list_transform(regexp_extract_all(question, '\\b(\\d+)\\b', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x BETWEEN 5 AND 1000) AS l FROM q)
SELECT qid, CASE WHEN regexp_matches(question, '(?i)\\breview\\b') THEN 'review' WHEN regexp_matches(question, '(?i)\\boverall\\b') THEN 'overall' WHEN regexp_matches(question, '(?i)\\btop\\b') THEN 'top' END AS choice,
l[1] AS number FROM q JOIN i USING (qid)""")
def bind_values(spark, d):
    """The first declared choice and the first number within bounds that a question holds."""
    asked = org.questions(spark, d)
    return asked.select("qid", Q.enum_value(F.col("question"), ["review", "overall", "top"]).alias("choice"), Q.int_value(F.col("question"), 5, 1000).alias("number"))


_BOUND_SQL = f"""{_LINK_SQL}, {ORG_SQL}, chosen AS (SELECT qid, question, {_TEMPLATE_SQL} AS template FROM q),
tried AS (SELECT c.qid, c.template, l.pos, l.entity_id, l.via, k.id IS NOT NULL AS known FROM chosen c
  LEFT JOIN linked l ON l.qid = c.qid AND l.kind = CASE c.template WHEN 'person_led_sigs' THEN 'person' WHEN 'kep_owning_sig' THEN 'kep' ELSE 'sig' END LEFT JOIN nodes k ON k.id = l.entity_id WHERE c.template IS NOT NULL),
hit AS (SELECT qid, template, arg_min(entity_id, pos) FILTER (WHERE known) AS id, 'link:' || arg_min(via, pos) FILTER (WHERE known) AS via, min(pos) FILTER (WHERE known) AS at FROM tried GROUP BY qid, template),
bound AS (SELECT h.qid, h.template, h.id, h.via, coalesce(string_agg(t.entity_id, ',' ORDER BY t.pos, t.entity_id) FILTER (WHERE t.entity_id IS NOT NULL AND NOT t.known AND (h.at IS NULL OR t.pos < h.at)), '') AS dropped
  FROM hit h JOIN tried t ON t.qid = h.qid GROUP BY ALL),
facts AS (SELECT DISTINCT b.qid, b.template, k.id FROM bound b JOIN edges e ON (b.template = 'sig_owned_keps' AND e.kind = 'OWNS' AND e.src = b.id) OR (b.template = 'sig_tech_leads' AND e.kind = 'TECH_LEADS' AND e.dst = b.id)
    OR (b.template = 'person_led_sigs' AND e.kind IN ('TECH_LEADS', 'CHAIRS') AND e.src = b.id) OR (b.template = 'kep_owning_sig' AND e.kind = 'OWNS' AND e.dst = b.id)
  JOIN nodes k ON k.id = CASE WHEN b.template IN ('sig_owned_keps', 'person_led_sigs') THEN e.dst ELSE e.src END)"""


def _bound(spark, d):
    asked, linked = _linked(spark, d)
    chosen = asked.select("qid", Q.template(F.col("question")).alias("template")).where("template is not null")
    return asking.bind_entities(chosen, linked, org.nodes(spark, d))


@query(f"WITH {_BOUND_SQL} SELECT qid, template, id, via, dropped FROM bound")
def bind_params(spark, d):
    return _bound(spark, d).select("qid", "template", "id", "via", F.array_join("dropped", ",").alias("dropped"))


@query(f"WITH {_BOUND_SQL} SELECT qid, template, id, 'deterministic' AS methods FROM facts")
def run_templates(spark, d):
    """All four fixed templates over the parameters that questions bind."""
    found = asking.run_templates(_bound(spark, d).where("id is not null"), org.edges(spark, d), org.nodes(spark, d))
    return found.select("qid", "template", "id", F.array_join("methods", ",").alias("methods"))


@query(f"""WITH {_BOUND_SQL}, f AS (SELECT qid, string_agg(id, ', ' ORDER BY id) AS ids FROM facts GROUP BY qid),
a AS (SELECT c.qid, c.template, c.question, b.id, f.ids, CASE WHEN c.template IS NULL THEN 'no_template' WHEN b.id IS NULL THEN 'unbound' ELSE 'answered' END AS outcome
  FROM chosen c LEFT JOIN bound b ON b.qid = c.qid LEFT JOIN f ON f.qid = c.qid)
SELECT qid, template, outcome, CASE WHEN outcome = 'answered' THEN 'Answer to: ' || question || ' ' || CASE WHEN ids IS NULL THEN 'No context was retrieved.' ELSE 'Graph facts: ' || ids || '.' END END AS answer FROM a""")
def governed_query(spark, d):
    asked, linked = _linked(spark, d)
    return asking.governed(asked, linked, org.edges(spark, d), org.nodes(spark, d))


@query(f"WITH {_LINK_SQL}, {ORG_SQL} SELECT l.qid, k.id, k.title, k.kind, row_number() OVER (PARTITION BY l.qid ORDER BY l.pos, l.entity_id) AS place FROM linked l JOIN nodes k ON k.id = l.entity_id")
def resolve_nodes(spark, d):
    """The nodes that questions name, in their order; names of nothing go."""
    ids = _linked(spark, d)[1].select("qid", "pos", F.col("entity_id").alias("id"))
    found = asking.resolved(ids, org.nodes(spark, d))
    return found.select("qid", "id", "title", "kind", F.expr("row_number() over (partition by qid order by pos, id)").cast("long").alias("place"))


@query("""SELECT conv_id || ':' || turn AS qid, CASE conv_id % 4 WHEN 0 THEN 'public-reader' WHEN 1 THEN 'member' WHEN 2 THEN 'maintainer' END AS persona, CASE conv_id % 4 WHEN 3 THEN 0 ELSE conv_id % 4 + 1 END::INT AS clearance
FROM conversations WHERE role = 'user'""")
def persona_clearance(spark, d):
    """The clearance of each question's persona; without one nothing is seen."""
    who = F.when(F.col("conv_id") % 4 == 0, "public-reader").when(F.col("conv_id") % 4 == 1, "member").when(F.col("conv_id") % 4 == 2, "maintainer")
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), who.alias("persona"))
    return asking.cleared(asked, spark.createDataFrame(asking.PERSONAS, "persona string, rank int"), default_deny=True)


@query(f"""WITH {_LINK_SQL}, {ORG_SQL}, ch AS (SELECT qid, generate_subscripts(h, 1) AS rank, unnest(h) AS id FROM (SELECT qid, [n * 3, n * 3 + 1, n * 3] AS h FROM q)),
told AS (SELECT c.qid, 0 AS leg, c.rank AS place, d.source || ':docs/' || d.doc_id || '#' || CASE WHEN d.doc_id % 2 = 0 THEN '(intro)' ELSE 'Part' END AS citation FROM ch c JOIN documents d ON d.doc_id = c.id
  UNION ALL SELECT l.qid, 1, l.pos, l.entity_id FROM linked l JOIN nodes k ON k.id = l.entity_id),
f AS (SELECT qid, citation, min([leg, place]) AS place FROM told GROUP BY qid, citation)
SELECT qid, citation, row_number() OVER (PARTITION BY qid ORDER BY place, citation) AS pos FROM f""")
def answer_citations(spark, d):
    """What answers cite: three documents of each question, one of them twice, then the entities it names."""
    asked, linked = _linked(spark, d)
    n = F.col("n").cast("long") * 3
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("Part").alias("heading"))
    chunks = asked.select("qid", F.posexplode(F.array(n, n + 1, n)).alias("rank", "id")).join(docs, "id")
    facts = linked.join(org.nodes(spark, d).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("qid", "pos", F.col("entity_id").alias("id"))
    return asking.citations(chunks, facts).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {ORG_SQL}, s AS (SELECT id AS qid, id FROM nodes WHERE kind = 'person'), adj AS (SELECT src, dst, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges),
c AS (SELECT s.qid, a.dst AS id, a.kind FROM s JOIN adj a ON a.src = s.id),
h1 AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (SELECT DISTINCT qid, id FROM c)) WHERE n <= 50),
h2 AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (SELECT DISTINCT h1.qid, a.dst AS id FROM h1 JOIN adj a ON a.src = h1.id
  WHERE a.dst <> h1.qid AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.qid = h1.qid AND x.id = a.dst))) WHERE n <= 50),
k AS (SELECT c.qid, 1 AS hop, c.kind FROM c JOIN h1 USING (qid, id) UNION ALL SELECT h1.qid, 2, a.kind FROM h1 JOIN adj a ON a.src = h1.id JOIN h2 ON h2.qid = h1.qid AND h2.id = a.dst)
SELECT qid, hop, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, 'deterministic' AS methods FROM k GROUP BY qid, hop""")
def hop_kinds(spark, d):
    """The edge kinds, and how edges of these kinds were found, that brought each hop's nodes."""
    nodes = org.nodes(spark, d)
    seeds = nodes.where("kind = 'person'").select(F.col("id").alias("qid"), "id")
    found = graph.hop_kinds(seeds, graph.bare(nodes, org.edges(spark, d, once=False)))
    return found.select("qid", "hop", F.array_join("kinds", ",").alias("kinds"), F.array_join("methods", ",").alias("methods"))
