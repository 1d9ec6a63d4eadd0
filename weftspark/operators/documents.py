"""Governed documents from files to quads: routing, cleansing, classification, triples, shapes, provenance, and runs over a delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import documents as D
from weftspark.functions import questions as Q
from weftspark.functions import text as T
from weftspark.operators import similar, vectors
from weftspark.operators.meeting import meet
from weftspark.operators.state import settle
from weftspark.operators.store import Store

# Which converter takes a file by its extension, classes of documents, and what a node of each class must have.
ROUTES = [(".docx", "pandoc"), (".pdf", "docling"), (".pptx", "markitdown"), (".xlsx", "markitdown"), (".md", "passthrough"), (".txt", "passthrough"), (".rst", "passthrough")]
CLASSES = ["Policy", "Standard", "Guideline", "SOP", "JobAid", "Transcript", "Chunk", "BusinessDomain", "Journey"]
NORMATIVE_RULES = [("name", 1, 0, "string"), ("effectiveDate", 1, 1, "date"), ("scope", 1, 0, None), ("hasPII", 1, 1, "boolean"), ("gitCommitSHA", 1, 0, "string")]
CONTENT_RULES = [("name", 1, 0, "string"), ("gitCommitSHA", 1, 0, "string")]
SHAPES = [
    *((c, *rule) for c in ("Policy", "Standard", "Guideline") for rule in NORMATIVE_RULES),
    *((c, *rule) for c in ("SOP", "JobAid", "Transcript") for rule in CONTENT_RULES),
    ("Chunk", "wasDerivedFrom", 1, 1, None), ("Chunk", "chunkIndex", 1, 0, "integer"), ("Chunk", "embeddingModel", 1, 0, "string"),
    ("BusinessDomain", "prefLabel", 1, 0, None), ("Journey", "prefLabel", 1, 0, None),
]
LEXICAL = {"date": r"^-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-]\d{2}:\d{2})?$", "boolean": "^(true|false|0|1)$", "integer": r"^[+-]?\d+$"}
SCANNED = 20


def shapes(spark: SparkSession) -> DataFrame:
    """(target_class, path, min_count, max_count, datatype): max_count 0 is no bound, a null datatype any."""
    return spark.createDataFrame(SHAPES, "target_class string, path string, min_count int, max_count int, datatype string")


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content) with text: UTF-8, what is none replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def is_scanned(text: Column) -> Column:
    """Whether extracted text is so little a page (pages end at form feeds) that the file must hold images."""
    bare = T.stripped(F.coalesce(text, F.lit("")))
    pages = F.regexp_count(text, F.lit("\x0c")) + 1
    return (bare == "") | (F.length(bare) / pages < SCANNED)


def route(files: DataFrame) -> DataFrame:
    """files (path, ...) with extension and extractor, null where no converter takes the extension."""
    table = F.create_map(*[F.lit(x) for pair in ROUTES for x in pair])
    ends = F.lower(F.regexp_extract(F.substring_index("path", "/", -1), r"^.+(\.[^.]*)$", 1))
    return files.withColumn("extension", ends).withColumn("extractor", F.try_element_at(table, F.col("extension")))


def emit(docs: DataFrame, repo: str) -> DataFrame:
    """(g, s, p, o, o_type) of docs (s, path, sha, extractor, text, pii_flagged): class, name, date, scope, personal data and four facts of origin."""
    told = docs.withColumn("_c", F.struct(*[c.alias(k) for k, c in D.classify(F.col("path"), F.col("text")).items()]))
    facts = [
        ("type", F.element_at(F.split("_c.class_uri", ":"), -1), "iri"), ("name", F.col("_c.name"), "string"), ("effectiveDate", F.col("_c.effective_date"), "date"), ("scope", F.col("_c.scope"), "string"),
        ("hasPII", F.col("pii_flagged").cast("string"), "boolean"), ("gitCommitSHA", F.col("sha"), "string"), ("gitPath", F.col("path"), "string"), ("gitRepo", F.lit(repo), "string"), ("extractorUsed", F.col("extractor"), "string"),
    ]
    listed = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(t).alias("o_type")) for p, o, t in facts])
    return told.select(F.col("_c.partition").alias("g"), "s", F.inline(listed)).where("o is not null")


def provenance(docs: DataFrame, repo: str) -> DataFrame:
    """(g, s, p, o, o_type): the chain from the file at its commit over the extracted text to the document, of docs (g, s, path, sha, extractor, started, ended).

    Seven entities and activities of each document, and its two agents; each triple once.
    """
    at = lambda kind: F.concat(F.lit(f"urn:{kind}:"), Q.encoded(F.col("s")), F.lit(":"), "sha")
    bronze = F.concat(F.lit("urn:entity:bronze:"), Q.encoded(F.lit(repo)), F.lit(":"), Q.encoded(F.col("path")), F.lit(":"), "sha")
    silver, extract, emitted = at("entity:silver"), at("activity:extract"), at("activity:emit")
    agent, writer, doc = F.concat(F.lit("urn:agent:"), "extractor"), F.lit("urn:agent:rdf-emitter"), F.col("s")
    facts = [
        (bronze, "type", F.lit("Entity"), "iri"), (bronze, "gitCommitSHA", F.col("sha"), "string"), (bronze, "gitPath", F.col("path"), "string"), (bronze, "gitRepo", F.lit(repo), "string"),
        (agent, "type", F.lit("SoftwareAgent"), "iri"),
        (extract, "type", F.lit("Activity"), "iri"), (extract, "used", bronze, "iri"), (extract, "wasAssociatedWith", agent, "iri"),
        (extract, "startedAtTime", Q.date_time(F.col("started")), "dateTime"), (extract, "endedAtTime", Q.date_time(F.col("ended")), "dateTime"),
        (silver, "type", F.lit("Entity"), "iri"), (silver, "wasGeneratedBy", extract, "iri"), (silver, "wasDerivedFrom", bronze, "iri"),
        (writer, "type", F.lit("SoftwareAgent"), "iri"),
        (emitted, "type", F.lit("Activity"), "iri"), (emitted, "used", silver, "iri"), (emitted, "wasAssociatedWith", writer, "iri"),
        (doc, "type", F.lit("Entity"), "iri"), (doc, "wasGeneratedBy", emitted, "iri"), (doc, "wasDerivedFrom", silver, "iri"),
    ]
    listed = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(t).alias("o_type")) for s, p, o, t in facts])
    return docs.select("g", F.inline(listed)).distinct()


def chunk_triples(chunks: DataFrame, model: str) -> DataFrame:
    """(g, s, p, o, o_type) of chunks (g, doc, ordinal): class, parent, place, model."""
    s = F.concat(F.lit("urn:chunk:"), "doc", F.lit("#"), F.col("ordinal").cast("string"))
    facts = [("type", F.lit("Chunk"), "iri"), ("wasDerivedFrom", F.col("doc"), "iri"), ("chunkIndex", F.col("ordinal").cast("string"), "integer"), ("embeddingModel", F.lit(model), "string")]
    return chunks.select("g", s.alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(t).alias("o_type")) for p, o, t in facts])))


def violations(quads: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, shape, path, rule, message): what the nodes of each shape's class break, one row a rule.

    The rules are sent to the quads, of which only those that a shape asks for are
    grouped, once, by node and path. There is no inference; a node of several classes meets the shapes of each.
    """
    rules = F.broadcast(rules)  # a row for each property of each shape
    focus = quads.where("p = 'type'").select("s", F.col("o").alias("target_class")).distinct().join(rules, "target_class")
    types = F.broadcast(rules.groupBy("path").agg(F.max("datatype").alias("asked")))
    lexical = F.lit(True)
    for name, words in LEXICAL.items():
        lexical = F.when(F.col("asked") == name, F.col("o").rlike(words)).otherwise(lexical)
    good = F.col("asked").isNull() | ((F.col("o_type") == F.col("asked")) & lexical)
    held = quads.join(types, quads["p"] == types["path"]).groupBy("s", "path").agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"))
    both = focus.join(held, ["s", "path"], "left").na.fill(0, ["n", "bad"])
    broken = lambda ok, rule, *text: F.when(ok, F.struct(F.lit(rule).alias("rule"), F.concat(*text).alias("message")))
    number = lambda c: F.col(c).cast("string")
    found = F.array_compact(
        F.array(
            broken(F.col("n") < F.col("min_count"), "minCount", F.lit("less than "), number("min_count"), F.lit(" values on "), "path"),
            broken((F.col("max_count") > 0) & (F.col("n") > F.col("max_count")), "maxCount", F.lit("more than "), number("max_count"), F.lit(" values on "), "path"),
            broken(F.col("datatype").isNotNull() & (F.col("bad") > 0), "datatype", F.lit("value is not of type "), "datatype", F.lit(" on "), "path"),
        )
    )
    return both.select("s", F.concat("target_class", F.lit("Shape")).alias("shape"), "path", F.inline(found))


def gated(quads: DataFrame, broken: DataFrame) -> DataFrame:
    """(s, outcome, reasons): of every document with a class whether it is loaded, or quarantined and for which paths and rules."""
    reasons = broken.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "rule"))), ";").alias("reasons"))
    rows = quads.where("p = 'type'").select("s").distinct().join(reasons, "s", "left")
    return rows.select("s", F.when(F.col("reasons").isNull(), "loaded").otherwise("quarantined").alias("outcome"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def quarantined(docs: DataFrame, broken: DataFrame, at: str) -> DataFrame:
    """(record, doc, reason, paths, commit, time) of the docs (s, sha) that break a shape, with all messages and paths."""
    told = broken.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("reason"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))
    record = F.concat(F.lit("urn:quarantine:"), "sha", F.lit(":"), F.substring(F.sha2("s", 256), 1, 16))
    return docs.select("s", "sha").distinct().join(told, "s").select(record.alias("record"), F.col("s").alias("doc"), "reason", "paths", F.col("sha").alias("commit"), F.lit(at).alias("time"))


def quarantine_quads(records: DataFrame) -> DataFrame:
    """The records (doc, reason, commit, time) as quads of the partition `quarantine`."""
    facts = [("type", F.lit("QuarantinedDocument"), "iri"), ("quarantineReason", F.col("reason"), "string"), ("gitCommitSHA", F.col("commit"), "string"), ("quarantineTime", F.col("time"), "dateTime")]
    return records.select(F.lit("quarantine").alias("g"), F.col("doc").alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(t).alias("o_type")) for p, o, t in facts])))


def process(files: DataFrame, spark: SparkSession, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, quads, chunks) of files (path, sha, text).

    A file without a converter is an error; one that fails a gate of cleansing or breaks a
    shape is quarantined with the reason; the others are loaded, and their quads and
    sentence chunks are given. Every file has its row (s, path, sha, outcome, reason, report columns).
    """
    named = route(files.select("path", "sha", "text")).withColumn("s", F.concat(F.lit("urn:doc:"), "path"))
    known = settle(T.cleansed(named.where("extractor is not null")))
    clean = known.where("not quarantined").select("s", "path", "sha", "extractor", F.col("clean_text").alias("text"), "pii_flagged")
    quads = settle(emit(clean, repo))
    broken = violations(quads, shapes(spark)).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "rule"))), ";").alias("broken"))
    told = known.join(broken, "s", "left")
    outcome = F.when(F.col("quarantined") | F.col("broken").isNotNull(), "quarantined").otherwise("loaded")
    reason = F.when(F.col("quarantined"), F.concat(F.lit("gate failed: "), "gate_failed")).otherwise(F.col("broken"))
    report = ["chars_raw", "chars_clean", "headers_stripped", "pii_entities"]
    errors = named.where("extractor is null").select(
        "s", "path", "sha", F.lit("error").alias("outcome"), F.concat(F.lit("unsupported extension: "), "extension").alias("reason"), F.length("text").cast("long").alias("chars_raw"), *[F.lit(0).cast("long").alias(c) for c in report[1:]]
    )
    outcomes = settle(told.select("s", "path", "sha", outcome.alias("outcome"), reason.alias("reason"), *report).unionByName(errors))
    loaded = outcomes.where("outcome = 'loaded'").select("s")
    chunks = T.sentences(clean.join(loaded, "s", "left_semi").select(F.col("s").alias("doc_id"), "text")).withColumnRenamed("doc_id", "s")
    return outcomes, quads.join(loaded, "s", "left_semi").select("g", "s", "p", "o", "o_type"), chunks


def process_embedded(files: DataFrame, spark: SparkSession, repo: str, model: str = "hash-256") -> tuple[DataFrame, DataFrame, DataFrame]:
    """`process` to the end: its chunks with their vectors (s, ordinal, text, v), and the quads of documents and of chunks, each chunk in its document's partition."""
    outcomes, quads, chunks = process(files, spark, repo)
    chunks = settle(vectors.embedded(chunks, ["s", "ordinal", "text"]))
    where = quads.where("p = 'type'").select("s", "g").distinct()
    told = chunk_triples(chunks.join(where, "s").select("g", F.col("s").alias("doc"), "ordinal"), model)
    return outcomes, quads.unionByName(told), chunks


def taxonomy(quads: DataFrame) -> DataFrame:
    """(g, s, p, o, o_type): the partition that each document stands in."""
    where = quads.where("p = 'type'").select("s", "g").distinct()
    return where.select(F.lit("taxonomy").alias("g"), "s", F.lit("inPartition").alias("p"), F.concat(F.lit("urn:graph:"), "g").alias("o"), F.lit("iri").alias("o_type"))


def removed(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """quads without those of the documents gone (s), of the chunks derived from them, and of their rows in the taxonomy; no partition is dropped."""
    chunks = quads.where("p = 'wasDerivedFrom'").join(gone.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    return quads.join(gone.select("s").unionByName(chunks).distinct(), "s", "left_anti").select("g", "s", "p", "o", "o_type")


def medallion(store: DataFrame, changes: DataFrame, files: DataFrame, spark: SparkSession, repo: str) -> tuple[DataFrame, DataFrame]:
    """(quads, outcomes) after a delta: changes (action, path) of files (path, sha, text) over a store of quads.

    Deleted and modified documents leave the store, added and modified ones are processed
    and enter it with their row in the taxonomy. Files that a change names and that are
    not there, and those that fail, are rows of outcomes; they hold up nothing.
    """
    gone = changes.where("action in ('modified', 'deleted')").select(F.concat(F.lit("urn:doc:"), "path").alias("s")).distinct()
    wanted = changes.where("action in ('added', 'modified')").select("path").distinct()
    outcomes, quads, _ = process(files.join(wanted, "path", "left_semi"), spark, repo)
    missing = wanted.join(files, "path", "left_anti").select(F.concat(F.lit("urn:doc:"), "path").alias("s"), "path", F.lit(None).cast("string").alias("sha"), F.lit("error").alias("outcome"), F.lit("file is missing").alias("reason"))
    fresh = quads.unionByName(taxonomy(quads))
    after = removed(store, gone).unionByName(fresh).dropDuplicates(["g", "s", "p", "o", "o_type"])
    return after, outcomes.select("s", "path", "sha", "outcome", "reason").unionByName(missing)


#: The tables of a governed run and what their rows are replaced by.
ARTIFACTS = {"reports": ["s"], "triples": ["s"], "chunks": ["s"]}


def write_artifacts(root: str, outcomes: DataFrame, quads: DataFrame, chunks: DataFrame) -> int:
    """Writes what a run made, by document and commit, into the store `root` of ARTIFACTS: reports, triples and chunks under one pointer; the version."""
    commits = outcomes.select("s", "sha").distinct()
    store = Store(outcomes.sparkSession, root, ARTIFACTS)
    return store.commit({"reports": outcomes, "triples": quads.join(commits, "s", "left"), "chunks": chunks.join(commits, "s", "left")}, whole=True)


def ontology(spark: SparkSession, loaded_at: str) -> tuple[DataFrame, DataFrame]:
    """(classes, quads): the classes (kind), and the activity that loaded them."""
    classes = spark.createDataFrame([(c,) for c in CLASSES], "kind string")
    facts = [("type", "Activity", "iri"), ("endedAtTime", loaded_at, "dateTime")]
    rows = [("ontology", "urn:activity:load-ontology", p, o, t) for p, o, t in facts]
    return classes, spark.createDataFrame(rows, "g string, s string, p string, o string, o_type string")


def pending(outcomes: DataFrame) -> DataFrame:
    """(action, path): what the next run takes in again besides its own changes, since the mark moves on past documents that failed."""
    return outcomes.where("outcome = 'error'").select(F.lit("modified").alias("action"), "path")


def resolve_citations(asked: DataFrame, quads: DataFrame, chain: DataFrame, chunk_text: DataFrame, excerpt: int = 200) -> DataFrame:
    """(uri, title, doc_type, partition, commit_sha, git_path, git_repo, extractor, excerpt, relevance, effective_date), one row for each of asked (uri, relevance).

    The walk goes from the document over its writing, the extracted text and the
    extraction to the file; columns are null where it ends. A chunk (chunk_text: s, text)
    has the beginning of its text and, without a date of its own, the date of its document.
    """
    props = quads.groupBy("s").agg(
        F.min("g").alias("partition"), *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in ("name", "type", "effectiveDate", "wasDerivedFrom")]
    )
    step = lambda p, a, b: chain.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    facts = chain.groupBy(F.col("s").alias("bronze")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in ("gitCommitSHA", "gitPath", "gitRepo")])
    rows = asked.select("uri", "relevance").distinct().join(props.withColumnRenamed("s", "uri"), "uri", "left")
    rows = rows.join(step("wasGeneratedBy", "uri", "emitted"), "uri", "left").join(step("used", "emitted", "silver"), "emitted", "left")
    rows = rows.join(step("wasGeneratedBy", "silver", "extract"), "silver", "left").join(step("used", "extract", "bronze"), "extract", "left")
    rows = rows.join(step("wasAssociatedWith", "extract", "agent"), "extract", "left").join(facts, "bronze", "left")
    dates = props.select(F.col("s").alias("wasDerivedFrom"), F.col("effectiveDate").alias("parent_date"))
    rows = rows.join(chunk_text.select(F.col("s").alias("uri"), F.substring("text", 1, excerpt).alias("excerpt")), "uri", "left").join(dates, "wasDerivedFrom", "left")
    day = F.coalesce("effectiveDate", F.when(F.col("excerpt").isNotNull(), F.col("parent_date")))
    told = rows.select(
        "uri", F.col("name").alias("title"), Q.local_name(F.col("type")).alias("doc_type"), "partition", F.col("gitCommitSHA").alias("commit_sha"), F.col("gitPath").alias("git_path"), F.col("gitRepo").alias("git_repo"),
        F.regexp_replace("agent", "^urn:agent:", "").alias("extractor"), "excerpt", "relevance", day.alias("effective_date"),
    )
    return told.groupBy("uri").agg(F.min(F.struct(*[c for c in told.columns if c != "uri"])).alias("c")).select("uri", "c.*")


def normative(quads: DataFrame, today: str, domain: str | None = None, domains: list[str] | None = None, include_future: bool = False) -> DataFrame:
    """(s, kind, name, scope, day, pii): every normative document in force, without a limit.

    A domain must be one of the known `domains`; else it is an error. Dates are compared
    where they are typed as such; a document with an untyped date is left out unless the future counts too.
    """
    if domain is not None and domains is not None and domain not in domains:
        raise ValueError(f"unknown domain {domain}")
    get = lambda p, ok=F.lit(True): F.min(F.when((F.col("p") == p) & ok, F.col("o")))
    typed = F.col("o_type") == "date"
    rows = quads.where("g = 'normative'").groupBy("s").agg(
        get("type").alias("kind"), get("name").alias("name"), get("scope").alias("scope"), get("effectiveDate").alias("day"), get("effectiveDate", typed).alias("typed"),
        F.bool_or((F.col("p") == "hasPII") & (F.col("o") == "true")).alias("pii"), F.array_distinct(F.collect_list(F.when(F.col("p") == "inDomain", F.col("o")))).alias("domains"),
    )
    rows = rows.where(F.col("kind").isin("Policy", "Standard", "Guideline"))
    if domain is not None:
        rows = rows.where(F.array_contains("domains", domain))
    if not include_future:
        rows = rows.where(F.col("day").isNull() | (F.col("typed") <= today))
    return rows.select("s", "kind", "name", "scope", "day", "pii")


def near_documents(contexts: DataFrame, chunks: DataFrame, held: DataFrame, least: float = 0.7) -> DataFrame:
    """(qid, s, kind, score, pii): the documents (s, kind, pii) with a chunk (chunk_id, s, v) at a cosine of `least` or more to a context (qid, q), each with its best score.

    There is no limit on how many: all pairs above the bound are found, see `similar.within`.
    """
    known = chunks.select("chunk_id", "s", "v").join(held.select("s", "kind", "pii"), "s")
    return similar.within(contexts, known, least, extra=["kind", "pii"], by="s").select("qid", "s", "kind", "score", "pii")


def retrieve(structured: DataFrame, hits: DataFrame, include_pii: bool = False, fresh: bool = False) -> DataFrame:
    """(qid, s, kind, leg, relevance, withheld): the structured leg, the same for every context (qid null), and what the vector leg (qid, s, kind, score, pii) adds to it.

    Hits only add documents, each with its best score; those with personal data stay as
    rows that are marked withheld, so that their number can be told, unless `include_pii`.
    fresh: hits hold each document once a context and none of the structured leg, so they need not be moved.
    """
    if fresh:
        extra = hits.withColumnRenamed("score", "relevance")
    else:
        extra = hits.groupBy("qid", "s").agg(F.max("score").alias("relevance"), F.min("kind").alias("kind"), F.bool_or("pii").alias("pii")).join(structured.select("s"), "s", "left_anti")
    own = structured.select(F.lit(None).cast(hits.schema["qid"].dataType).alias("qid"), "s", "kind", F.lit("structured").alias("leg"), F.lit(None).cast("double").alias("relevance"), "pii")
    legs = own.unionByName(extra.select("qid", "s", "kind", F.lit("vector").alias("leg"), "relevance", "pii"))
    return legs.select("qid", "s", "kind", "leg", "relevance", (F.col("pii") & ~F.lit(include_pii)).alias("withheld"))


def get_policies(quads: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(uri, title, effective_date, domain) of every policy with a name; with params (domain), of those whose scope is one of them."""
    get = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    rows = quads.where("g = 'normative'").groupBy("s").agg(get("type").alias("kind"), get("name").alias("title"), get("effectiveDate").alias("effective_date"), get("scope").alias("domain"))
    rows = rows.where("kind = 'Policy' and title is not null").select(F.col("s").alias("uri"), "title", "effective_date", "domain")
    return rows if params is None else rows.join(params.select("domain").distinct(), "domain", "left_semi").select("uri", "title", "effective_date", "domain")


def policies_by_domain(quads: DataFrame, params: DataFrame) -> DataFrame:
    """The template of that name over params (qid, domain): rows as of `get_policies` with their qid; a null domain is an error."""
    told = params.select("qid", F.when(F.col("domain").isNull(), F.raise_error(F.lit("domain is required")).cast("string")).otherwise(F.col("domain")).alias("domain"))
    return meet(told, get_policies(quads, params), ["domain"]).select("qid", "uri", "title", "effective_date", "domain")


def unshaped(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, what): classes without a shape, and shapes of no class."""
    shaped = rules.select(F.col("target_class").alias("kind")).distinct()
    lacking = classes.select("kind").join(shaped, "kind", "left_anti").withColumn("what", F.lit("no_shape"))
    return lacking.unionByName(shaped.join(classes.select("kind"), "kind", "left_anti").withColumn("what", F.lit("no_class")))


def typed_documents(quads: DataFrame) -> DataFrame:
    """(s, type, name, partition), one row a subject: the normative partition's first."""
    rows = quads.where(F.col("g").isin("normative", "descriptive")).groupBy("s", "g").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in ("type", "name")])
    first = F.max(F.struct("g", "type", "name")).alias("m")
    return rows.where("type is not null").groupBy("s").agg(first).select("s", "m.type", "m.name", F.col("m.g").alias("partition"))


def subgraph(roots: DataFrame, quads: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around roots (qid, uri): nodes (qid, uri, type, label) and distinct edges (qid, subject, predicate, object).

    Every hop, two at most, takes the triples of the frontier in both directions.
    Literals are leaves of type `literal`; of a subject the type and name it states count,
    of other nodes the last part of their URI is the label.
    """
    rows = quads.select("s", "p", "o", ((F.col("o_type") == "iri") & F.col("o").rlike("^(http:|https:|urn:)")).alias("is_uri"))
    both = rows.select(F.col("s").alias("at"), "s", "p", "o", "is_uri").unionByName(rows.where("is_uri").select(F.col("o").alias("at"), "s", "p", "o", "is_uri"))
    both = settle(both)
    seen = front = roots.select("qid", F.col("uri").alias("at")).distinct()
    edges = None
    for _ in range(min(hops, 2)):
        found = front.join(both, "at").select("qid", "s", "p", "o", "is_uri").distinct()
        found = settle(found)
        edges = found if edges is None else edges.unionByName(found).distinct()
        ends = found.select("qid", F.col("s").alias("at")).unionByName(found.where("is_uri").select("qid", F.col("o").alias("at"))).distinct()
        front = settle(ends.join(seen, ["qid", "at"], "left_anti"))
        seen = seen.unionByName(front)
    facts = quads.groupBy(F.col("s").alias("uri")).agg(F.min(F.when(F.col("p") == "type", F.col("o"))).alias("type"), F.min(F.when(F.col("p") == "name", F.col("o"))).alias("name"))
    last = F.element_at(F.split("uri", ":"), -1)
    told = seen.select("qid", F.col("at").alias("uri")).join(facts, "uri", "left").select("qid", "uri", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("name", last).alias("label"))
    leaves = edges.where("not is_uri").select("qid", F.col("o").alias("uri"), F.lit("literal").alias("type"), F.substring("o", 1, 60).alias("label")).distinct()
    return told.unionByName(leaves), edges.select("qid", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))


#: A node with more edges is a hub, whose edges are counted once for all questions that reach it.
HUB = 1000


def subgraph_sizes(roots: DataFrame, quads: DataFrame, hub: int = HUB) -> DataFrame:
    """(qid, edges, targets, leaves, subjects): how many edges `subgraph` finds within two hops, and how many URIs and literals as objects and subjects they have.

    A node with more than `hub` edges is not walked for each question: what the hubs of a
    question hold is counted once for each set of hubs, and the other edges of the question
    count as far as the hubs don't hold the same.
    """
    is_uri = (F.col("o_type") == "iri") & F.col("o").rlike("^(http:|https:|urn:)")
    rows = settle(quads.select("s", "p", "o", is_uri.alias("is_uri")).distinct())
    both = rows.select(F.col("s").alias("at"), "s", "p", "o", "is_uri").unionByName(rows.where("is_uri and s <> o").select(F.col("o").alias("at"), "s", "p", "o", "is_uri"))
    both = settle(both)
    hubs = settle(both.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("at"))
    light = settle(both.join(hubs, "at", "left_anti"))
    start = settle(roots.select("qid", F.col("uri").alias("at")).distinct())
    # the first hop: the ends of a root's edges, walked in full, as a root is a node of its own
    ends = start.join(both, "at").select("qid", F.inline(F.array(F.struct(F.col("s").alias("at")), F.struct(F.when(F.col("is_uri"), F.col("o")).alias("at")))))
    front = settle(ends.where("at is not null").unionByName(start).distinct())
    sets = settle(front.join(hubs, "at", "left_semi").groupBy("qid").agg(F.array_sort(F.collect_set("at")).alias("hubs")))
    every = sets.select("hubs").distinct()
    held = settle(every.select("hubs", F.explode("hubs").alias("at")).join(both, "at").select("hubs", "s", "p", "o", "is_uri").distinct())
    none = F.array().cast("array<string>")
    near = front.join(light, "at").select("qid", "s", "p", "o", "is_uri").distinct().join(sets, "qid", "left").withColumn("hubs", F.coalesce("hubs", none))
    extra = settle(near.join(held.select("hubs", "s", "p", "o"), ["hubs", "s", "p", "o"], "left_anti"))

    def parts(df: DataFrame) -> dict[str, DataFrame]:
        key = [c for c in ("qid", "hubs") if c in df.columns]
        return {
            "edges": df.select(*key, F.struct("s", "p", "o").alias("x")), "targets": df.where("is_uri").select(*key, F.col("o").alias("x")),
            "leaves": df.where("not is_uri").select(*key, F.col("o").alias("x")), "subjects": df.select(*key, F.col("s").alias("x")),
        }

    whole, more = parts(held), parts(extra)
    found = front.select("qid").distinct().join(sets, "qid", "left").withColumn("hubs", F.coalesce("hubs", none))
    for name in ("edges", "targets", "leaves", "subjects"):
        once = whole[name].distinct()
        sums = once.groupBy("hubs").agg(F.count("*").alias("_held"))
        adds = more[name].distinct().join(once, ["hubs", "x"], "left_anti").groupBy("qid").agg(F.count("*").alias("_more"))
        found = found.join(sums, "hubs", "left").join(adds, "qid", "left").withColumn(name, F.coalesce("_held", F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_held", "_more")
    return found.where("edges > 0").select("qid", "edges", "targets", "leaves", "subjects")
