"""Questions answered over a graph: linking, filters, parameters, fixed templates and governed answers, for whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.functions import text as T
from weftspark.operators.meeting import meet
from weftspark.operators.state import few, settle

#: Personas with the highest rank that each may see.
PERSONAS = [("public-reader", 1), ("member", 2), ("maintainer", 3)]
#: Strategies that a decision may name.
STRATEGIES = ["structured", "graph_expand", "hybrid_graph", "global", "vector_only"]
#: Templates with the kind of entity each takes, the edges it follows and in which direction.
TEMPLATES = [
    ("sig_owned_keps", "sig", ["OWNS"], ">"),
    ("sig_tech_leads", "sig", ["TECH_LEADS"], "<"),
    ("person_led_sigs", "person", ["TECH_LEADS", "CHAIRS"], ">"),
    ("kep_owning_sig", "kep", ["OWNS"], "<"),
]


def link(questions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(qid, pos, surface, entity_id, kind, via): what each question (qid, question) names, each entity where it is found first.

    Patterns come before display names. aliases (alias, handle), of any number, are met by
    their words: every run of as many words as an alias has is looked up by equality.
    """
    found = questions.select("qid", F.posexplode(Q.mentions(F.col("question"))).alias("pos", "m")).select("qid", "pos", "m.*")
    if aliases is None:
        return found
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    known = aliases.select("alias", "handle", words(F.col("alias")).alias("w")).where(F.size("w") > 0)
    known = known.select("alias", "handle", F.array_join("w", " ").alias("run"), F.size("w").alias("n"))
    sizes = F.array(*[F.lit(r["n"]) for r in known.select("n").distinct().orderBy("n").collect()]).cast("array<int>")  # the lengths that occur: few
    runs = questions.select("qid", "question", words(F.col("question")).alias("w"))
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = runs.select("qid", "question", F.explode(F.array_distinct(F.flatten(F.transform(sizes, of_size)))).alias("run"))
    named = runs.join(known, "run").where(F.regexp_like("question", F.concat(F.lit(r"(?i)\b\Q"), "alias", F.lit(r"\E\b"))))
    named = named.select(
        "qid", F.lit(1 << 20).alias("pos"), F.col("alias").alias("surface"), F.concat(F.lit("person:"), T.handle(F.col("handle"))).alias("entity_id"), F.lit("person").alias("kind"), F.lit("alias").alias("via")
    )
    first = F.min(F.struct("pos", "surface", "kind", "via")).alias("m")
    return found.unionByName(named).groupBy("qid", "entity_id").agg(first).select("qid", "m.pos", "m.surface", "entity_id", "m.kind", "m.via")


def resolved(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (qid, pos, id) with the nodes they name; those that name none go, the order stays in pos."""
    return ids.join(nodes, "id")


def cleared(asked: DataFrame, personas: DataFrame, default_deny: bool = False) -> DataFrame:
    """asked (qid, persona) with clearance: null without a persona, 0 where `default_deny` has that see nothing. An unknown persona is an error."""
    found = asked.join(F.broadcast(personas.toDF("persona", "clearance")), "persona", "left")
    unknown = F.col("clearance").isNull() & (F.coalesce("persona", F.lit("")) != "")
    none = F.lit(0) if default_deny else F.lit(None).cast("int")
    refused = F.raise_error(F.concat(F.lit("unknown persona "), F.col("persona"))).cast("int")
    return found.select("qid", "persona", F.when(unknown, refused).when(F.col("clearance").isNull(), none).otherwise(F.col("clearance")).alias("clearance"))


def raw_filters(linked: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, field, pos, value): the sources that a question names and the surfaces of its entities."""
    named = questions.select("qid", F.lit("source").alias("field"), F.posexplode(Q.sources(F.col("question"))).alias("pos", "value"))
    return named.unionByName(linked.select("qid", F.lit("entity_ids").alias("field"), "pos", F.col("surface").alias("value")))


def checked_filters(raw: DataFrame, aliases: DataFrame, choices: list[str]) -> DataFrame:
    """(qid, field, value, reason): values of raw (qid, field, pos, value) that may filter, with a null reason, and those dropped with why.

    A source must be one of the choices; an entity is linked anew and stands for the first thing it names.
    """
    entities = raw.where("field = 'entity_ids'").select(F.struct("qid", "pos", "value").alias("qid"), F.col("value").alias("question"))
    again = link(entities, aliases).groupBy("qid").agg(F.min_by("entity_id", "pos").alias("to"))
    found = entities.join(again, "qid", "left").select(
        "qid.qid", F.lit("entity_ids").alias("field"), F.coalesce("to", "qid.value").alias("value"), F.when(F.col("to").isNull(), "no declared-entity match").alias("reason")
    )
    rest = raw.where("field <> 'entity_ids'").select(
        "qid", "field", "value", F.when(F.col("field") != "source", "undeclared field").when(~F.col("value").isin(choices), "not in enum").alias("reason")
    )
    return found.unionByName(rest).distinct()


def matching(filters: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id): the chunks (chunk_id, field, value: one row for each value) that each question's filters (qid, field, value) let through.

    A field is met by any of its values, and all of a question's fields must be met. A
    question without a filter lets all through and has no rows here.

    Questions with the same filters let the same chunks through, so these are found once for
    each set of filters and met by the questions that state it.
    """
    asked = settle(filters.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("field", "value"))).alias("wanted")))
    values = asked.select("wanted").distinct().select("wanted", F.inline("wanted"))
    met = values.join(chunks.select("chunk_id", "field", "value").distinct(), ["field", "value"]).groupBy("wanted", "chunk_id").agg(F.count_distinct("field").alias("met"))
    fields = F.size(F.array_distinct(F.transform("wanted", lambda x: x["field"])))
    return meet(asked, met.where(F.col("met") == fields).select("wanted", "chunk_id"), ["wanted"]).select("qid", "chunk_id")


def decided(questions: DataFrame, proposals: DataFrame) -> DataFrame:
    """(qid, strategy, decided_by) of questions (qid, question): the rule's strategy, and where that is ambiguous what was proposed (qid, proposed).

    A proposal outside the closed set falls back to hybrid_graph; an ambiguous question without a proposal is an error.
    """
    rows = questions.select("qid", Q.strategy(F.col("question")).alias("rule")).join(proposals.select("qid", "proposed"), "qid", "left")
    open_ = F.col("rule") == "ambiguous"
    good = F.col("proposed").isin(STRATEGIES)
    missing = F.raise_error(F.concat(F.lit("no decision for "), F.col("qid"))).cast("string")
    found = F.when(~open_, F.col("rule")).when(F.col("proposed").isNull(), missing).when(good, F.col("proposed")).otherwise("hybrid_graph")
    return rows.select("qid", found.alias("strategy"), F.when(open_ & good, "model").otherwise("rule").alias("decided_by"))


def bind_entities(chosen: DataFrame, linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, template, id, via, dropped): for each (qid, template) the first linked entity of the template's kind that is a node.

    dropped lists those before it that are none; without any, id is null: the question is refused.
    """
    kinds = F.create_map(*[F.lit(x) for t, kind, *_ in TEMPLATES for x in (t, kind)])
    wanted = chosen.select("qid", "template", kinds[F.col("template")].alias("kind"))
    tried = wanted.join(linked, ["qid", "kind"], "left").join(nodes.select(F.col("id").alias("entity_id"), F.lit(True).alias("known")), "entity_id", "left")
    got = F.array_sort(F.collect_list(F.when(F.col("entity_id").isNotNull(), F.struct("pos", "entity_id", "via", F.coalesce("known", F.lit(False)).alias("known")))))
    tried = tried.groupBy("qid", "template").agg(got.alias("c"))
    hit = F.get(F.filter("c", lambda x: x["known"]), 0)
    before = F.filter("c", lambda x: ~x["known"] & (hit.isNull() | (x["pos"] < hit["pos"])))
    return tried.select("qid", "template", hit["entity_id"].alias("id"), F.concat(F.lit("link:"), hit["via"]).alias("via"), F.transform(before, lambda x: x["entity_id"]).alias("dropped"))


def template_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(template, at, id, methods): the nodes that each template finds for each id it may be bound to, each once.

    Edges are read once, each as a step of the templates that follow it.
    """
    steps = [
        F.when(F.col("kind").isin(kinds), F.struct(F.lit(name).alias("template"), F.col("src" if way == ">" else "dst").alias("at"), F.col("dst" if way == ">" else "src").alias("to"), Q.method(F.col("kind")).alias("method")))
        for name, _, kinds, way in TEMPLATES
    ]
    every = sorted({kind for _, _, kinds, _ in TEMPLATES for kind in kinds})
    hop = edges.where(F.col("kind").isin(every)).select(F.inline(F.array_compact(F.array(*steps))))
    found = hop.groupBy("template", "at", "to").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    found = found.join(nodes.select(F.col("id").alias("to"), F.col("kind").alias("node_kind")), "to")
    return found.where((F.col("template") != "person_led_sigs") | (F.col("node_kind") == "sig")).select("template", "at", F.col("to").alias("id"), "methods")


def run_templates(bound: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, template, id, methods): the nodes that each template finds for its bound id, each once; values are joined, never put into text.

    What a template finds is worked out once for each id, and met by the questions that bind it.
    """
    asked = bound.select("qid", "template", F.col("id").alias("at")).distinct()
    return meet(asked, template_facts(edges, nodes), ["template", "at"]).select("qid", "template", "id", "methods")


#: Answers that a task of `governed` should make, and their characters: each may list all that a group owns.
ANSWERS, CHARACTERS = 64, 1 << 25


def governed(questions: DataFrame, linked: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, template, outcome, answer): select, bind, run, answer; a question without a template or parameter is refused and runs nothing.

    Facts are listed once for each template and id that is bound, as an answer tells them, and the list is met by the questions that bind it,
    fewer in a task the longer the lists are: nothing holds many answers at once.
    """
    chosen = settle(questions.select("qid", "question", Q.template(F.col("question")).alias("template")))
    bound = bind_entities(chosen.where("template is not null"), linked, nodes).select("qid", F.col("id").alias("at"))
    rows = settle(chosen.join(bound, "qid", "left"))
    asked, keys = rows.where("at is not null"), ["template", "at"]
    wanted = settle(asked.select(*keys).distinct())
    facts = template_facts(edges, nodes).join(few(wanted), keys, "left_semi").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("facts"))
    none = F.array().cast("array<string>")
    listed = F.when(F.col("facts").isNull(), none).otherwise(F.array("facts"))
    said = settle(wanted.join(facts, keys, "left").select(*keys, Q.context(none, listed).alias("said")))
    longest = said.agg(F.max(F.length("said"))).first()[0] or 1
    told = meet(said, asked, keys, max(1, min(ANSWERS, CHARACTERS // longest)), 4)
    answered = told.select("qid", "template", F.lit("answered").alias("outcome"), Q.answered(F.col("question"), F.col("said")).alias("answer"))
    outcome = F.when(F.col("template").isNull(), "no_template").otherwise("unbound")
    return answered.unionByName(rows.where("at is null").select("qid", "template", outcome.alias("outcome"), F.lit(None).cast("string").alias("answer")))


def citations(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, citation, pos): what an answer cites, chunks (qid, rank, source, path, heading) before facts (qid, pos, id), each once where it comes first."""
    told = chunks.select("qid", F.struct(F.lit(0).alias("leg"), F.col("rank").cast("long").alias("at")).alias("at"), Q.cited(F.col("source"), F.col("path"), F.col("heading")).alias("citation"))
    told = told.unionByName(facts.select("qid", F.struct(F.lit(1).alias("leg"), F.col("pos").cast("long").alias("at")).alias("at"), F.col("id").alias("citation")))
    first = told.groupBy("qid", "citation").agg(F.min("at").alias("at"))
    return first.select("qid", "citation", F.row_number().over(Window.partitionBy("qid").orderBy("at", "citation")).alias("pos"))


def routed(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (qid, engine, reason) with what the router says of the questions, and whether it agrees."""
    told = questions.select("qid", Q.engine(F.col("question")).alias("r")).select("qid", F.col("r.engine").alias("got_engine"), F.col("r.reason").alias("got_reason"))
    agrees: Column = F.coalesce((F.col("engine") == F.col("got_engine")) & (F.col("reason") == F.col("got_reason")), F.lit(False))
    return expected.join(told, "qid", "left").withColumn("passes", agrees)
