"""What a question says: the entities it names, where it is routed, which template and parameters it asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftspark.functions import text as T

# How questions name entities, words that name no group, and the cues of routes, strategies and sources.
KEP = r"(?i)\bKEP[-\s]?(\d+)\b"
SIG_AFTER = r"(?i)\bSIG[-\s]+([A-Za-z][A-Za-z0-9-]*)"
SIG_BEFORE = r"(?i)\b([A-Za-z][A-Za-z0-9-]*)[-\s]+SIG\b"
HANDLE = r"@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)"
NO_SIG = ["the", "a", "an", "this", "that", "which", "owning", "owns"]
GLOBAL_CUES = [
    "overall", "across all", "across the", "in general", "themes", "landscape", "summarize", "summary", "how many", "which sigs", "what are",
    "big picture", "broadly",
]
URI = r"(?:urn:|https?://|biz:)\S+"
AGGREGATION = ["how many", "count", "list all", "total", "sum"]
RELATION = ["related to", "relate to", "relates to", "connected to", "links to", "refers to"]
THEMATIC = ["broadly", "in general", "overview", "tell me about"]
SOURCES = [("enhancements", ["enhancement", "enhancements", "kep repo"]), ("community", ["community"])]

CANDIDATE = "array<struct<surface:string,entity_id:string,kind:string,via:string>>"


def mentions(question: Column) -> Column:
    """Array of (surface, entity_id, kind, via): what a question names, by pattern, each entity where it is found first."""

    def of(words: str, kind: str, via: str, entity: object, drop: list[str] | None = None) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(question, F.lit(words), F.lit(0)).alias("s"), F.regexp_extract_all(question, F.lit(words), F.lit(1)).alias("b"))
        if drop:
            found = F.filter(found, lambda x: ~F.lower(x["b"]).isin(drop))
        return F.transform(found, lambda x: F.struct(x["s"].alias("surface"), entity(x["b"]).alias("entity_id"), F.lit(kind).alias("kind"), F.lit(via).alias("via")))

    every = F.concat(
        of(KEP, "kep", "kep-number", T.numbered),
        of(SIG_AFTER, "sig", "slug", T.sig_id, NO_SIG),
        of(SIG_BEFORE, "sig", "slug", T.sig_id, NO_SIG),
        of(HANDLE, "person", "handle", lambda b: F.concat(F.lit("person:"), T.handle(b))),
    )
    first = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["entity_id"] == x["entity_id"]))
    return F.element_at(F.transform(F.array(every), first), 1)


def _says(question: Column, cues: list[str]) -> Column:
    return T.has_cue(question, cues)


def engine(question: Column) -> Column:
    """(engine, reason): an entity anchor beats a corpus-wide cue."""
    anchor, cue = F.size(mentions(question)) > 0, _says(question, GLOBAL_CUES)
    reason = (
        F.when(anchor & ~cue, "anchor_no_cue").when(anchor, "anchor_beats_cue").when(cue, "cue_no_anchor").otherwise("default_local")
    )
    return F.struct(F.when(~anchor & cue, "global").otherwise("hybrid").alias("engine"), reason.alias("reason"))


def strategy(question: Column, uris: Column | None = None) -> Column:
    """structured, graph_expand, ambiguous, hybrid_graph, global or vector_only; uris are those that an analysis supplies."""
    found = F.regexp_extract_all(question, F.lit(URI), F.lit(0))
    n = F.size(F.array_distinct(found if uris is None else F.concat(F.coalesce(uris, F.array().cast("array<string>")), found)))
    return (
        F.when(_says(question, AGGREGATION), "structured")
        .when(_says(question, RELATION) & (n > 0), "graph_expand")
        .when(n >= 2, "ambiguous")
        .when(n == 1, "hybrid_graph")
        .when(_says(question, THEMATIC), "global")
        .otherwise("vector_only")
    )


def template(question: Column) -> Column:
    """The template that a question asks for by the kinds it names and its cues; null if none fits."""

    def of(kinds: Column) -> Column:
        has = lambda kind: F.array_contains(kinds, kind)
        return (
            F.when(has("sig") & _says(question, ["tech-lead", "tech lead"]), "sig_tech_leads")
            .when(has("sig") & _says(question, ["own", "kep"]), "sig_owned_keps")
            .when(has("kep") & _says(question, ["own", "sig"]), "kep_owning_sig")
            .when(has("person") & _says(question, ["sig", "lead", "chair"]), "person_led_sigs")
            .when(has("sig"), "sig_owned_keps")
        )

    kinds = F.transform(mentions(question), lambda x: x["kind"])
    return F.element_at(F.transform(F.array(kinds), of), 1)  # what a question names is looked for once


def sources(question: Column) -> Column:
    """The sources that a question names, in the order in which they are declared."""
    return F.array_compact(F.array(*[F.when(_says(question, words), name) for name, words in SOURCES]))


def enum_value(question: Column, choices: list[str]) -> Column:
    """The first declared choice that stands as a word in the question."""
    return F.coalesce(*[F.when(question.rlike(rf"(?i)\b\Q{c}\E\b"), c) for c in choices])


def int_value(question: Column, least: int | None = None, most: int | None = None) -> Column:
    """The first whole number in the question within the bounds."""
    numbers = F.transform(F.regexp_extract_all(question, F.lit(r"\b(\d+)\b"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    fits = lambda x: x.isNotNull() & (F.lit(True) if least is None else x >= least) & (F.lit(True) if most is None else x <= most)
    return F.get(F.filter(numbers, fits), 0)


def local_name(uri: Column) -> Column:
    """After the last #, else after the last /."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def parent_key(chunk: Column) -> Column:
    """What stands before the last #; an id without one is its own parent."""
    return F.regexp_replace(chunk, r"#[^#]*$", "")


def ordinal(chunk: Column) -> Column:
    """The number after the last #, 0 where there is none; the largest one if it has more than 18 digits."""
    digits = F.regexp_replace(F.regexp_extract(chunk, r"#(\d+)$", 1), "^0+", "")
    return F.when(F.length(digits) > 18, F.lit(2**63 - 1)).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))


def encoded(segment: Column) -> Column:
    """Percent-encoded but for letters, digits and /:@.-_~."""
    out = F.url_encode(segment)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def date_time(ts: Column) -> Column:
    """xsd:dateTime of a timestamp without zone, which counts as UTC; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))


def label(title: Column, name: Column, id_: Column) -> Column:
    """The first of title, name and id that says anything."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(name, F.lit("")), id_)


def method(kind: Column) -> Column:
    """How an edge of a kind was found: by prose rules or by structure, from the kind alone."""
    return F.when(kind.isin("COLLABORATES_WITH", "SUPERSEDES", "DEPENDS_ON"), "schema-guided-llm").otherwise("deterministic")


def cited(source: Column, path: Column, heading: Column) -> Column:
    return F.concat(source, F.lit(":"), path, F.lit("#"), F.coalesce(F.nullif(heading, F.lit("")), F.lit("(intro)")))


def context(chunks: Column, facts: Column) -> Column:
    """What an answer tells of the ids of chunks and facts, both arrays."""
    listed = lambda a: F.array_join(a, ", ")
    return F.concat_ws(
        " ",
        F.when(F.size(chunks) > 0, F.concat(F.lit("Grounded on "), F.size(chunks).cast("string"), F.lit(" chunk(s): "), listed(chunks), F.lit("."))),
        F.when(F.size(facts) > 0, F.concat(F.lit("Graph facts: "), listed(facts), F.lit("."))),
        F.when((F.size(chunks) == 0) & (F.size(facts) == 0), "No context was retrieved."),
    )


def answered(question: Column, said: Column) -> Column:
    """The fixed answer text over a context."""
    return F.concat_ws(" ", F.concat(F.lit("Answer to: "), question), F.when(said != "", said))


def answer(question: Column, chunks: Column, facts: Column) -> Column:
    """The fixed answer text over the ids of chunks and facts, both arrays."""
    return answered(question, context(chunks, facts))
