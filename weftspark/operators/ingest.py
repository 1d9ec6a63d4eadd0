"""Ingest runs over a corpus: full, incremental, staged through a cache of artifacts, and rebuilt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions import questions as Q
from weftspark.operators import delta, state
from weftspark.operators.graph import rank
from weftspark.operators.state import settle
from weftspark.operators.store import Artifacts, Store, united

Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def merged(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """(*keys, kind?, docs, sources, props) of rows (*keys, doc, props): documents united, each property from the first document that says it.

    Documents come in the order of `order`, by default of their ids. The kind is a key of an
    edge; of a node it is a fact, on which its documents must agree: two kinds are an error.
    """
    facts = [F.min("kind").alias("kind"), F.max("kind").alias("_other")] if "kind" not in keys else []
    place = order if order is not None else F.col("doc")
    entry = F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("k"), F.col("_at"), e["value"].alias("v")))
    kept = rows.withColumn("_at", place).withColumn("_said", F.when(F.size("props") > 0, entry)).select(*rows.drop("props").columns, "_said")
    # Rows are moved once, as they are: most keys have few, of which sets on the way would only make more.
    found = kept.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("doc", "_said")).alias("_rows"), *facts)
    told = F.flatten(F.filter(F.transform("_rows", lambda x: x["_said"]), lambda x: x.isNotNull()))
    docs = F.filter(F.array_distinct(F.transform("_rows", lambda x: x["doc"])), lambda x: x.isNotNull())
    found = found.withColumn("docs", F.array_sort(docs)).withColumn("_said", F.array_sort(told)).select(*keys, "docs", *[c for c in ("kind", "_other") if facts], "_said")
    if facts:
        clash = F.raise_error(F.concat(F.lit("kinds clash at "), F.col(keys[0]))).cast("string")
        found = found.withColumn("kind", F.when(F.col("kind") != F.col("_other"), clash).otherwise(F.col("kind"))).drop("_other")
    first = lambda k: F.get(F.filter("_said", lambda e: e["k"] == k), F.lit(0))["v"]
    names = F.array_distinct(F.transform("_said", lambda e: e["k"]))
    props = F.when(F.size("_said") > 0, F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("k"), first(k).alias("v")))))
    sources = F.array_sort(F.array_distinct(F.transform("docs", lambda x: F.substring_index(x, "/", 1))))
    return found.withColumn("sources", sources).withColumn("props", props).drop("_said")


def labelled(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with their tier: of a node its label, public without one, of an edge the higher one of its ends."""
    tiers = nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("tier", F.lit("public")).alias("tier"))
    names = F.create_map(F.lit(1), F.lit("public"), F.lit(2), F.lit("internal"), F.lit(3), F.lit("restricted"))
    ends = tiers.select("id", rank(F.col("tier")).alias("r"))
    both = edges.join(ends.toDF("src", "r1"), "src", "left").join(ends.toDF("dst", "r2"), "dst", "left")
    tier = names[F.coalesce(F.greatest("r1", "r2"), F.lit(1))]
    return nodes.join(tiers, "id"), both.withColumn("tier", tier).drop("r1", "r2")


def full(docs: DataFrame, extract: Extract, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus from nothing: extracted, merged, labelled. A rebuild is this over an empty store."""
    nodes, edges = extract(docs)
    return labelled(merged(nodes, ["id"]), merged(edges, ["src", "kind", "dst"]), labels)


def report(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(what, kind, n): documents, nodes and edges by kind, and nodes that several sources tell of."""
    count = lambda df, what, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    found = count(nodes, "node", F.col("kind")).unionByName(count(edges, "edge", F.col("kind"))).unionByName(count(docs, "document", F.col("kind")))
    return found.unionByName(count(nodes.where(F.size("sources") > 1), "merge", F.col("kind")))


class Delta:
    """What changes between two manifests (doc_id, hash): the classified documents, those to read anew and those to drop."""

    def __init__(self, before: DataFrame | None, after: DataFrame, changes: DataFrame | None = None):
        """before: null where nothing was ingested yet; then every document is added. changes: the difference, if it is known."""
        empty = after.limit(0)
        changes = settle(delta.diff(before if before is not None else empty, after)) if changes is None else changes
        self.classified = delta.with_moves(changes)
        self.read = changes.where("action in ('added', 'changed')").select("doc_id")
        self.drop = changes.where("action in ('changed', 'deleted')").select(F.col("doc_id").alias("doc"))


def incremental(store: tuple[DataFrame, DataFrame], docs: DataFrame, change: Delta, extract: Extract) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows, node plan, edge plan) after a delta: store holds rows (id, kind, doc, props) and (src, kind, dst, doc, props).

    Only the documents of the delta are read. Rows of dropped documents leave, those of
    read ones enter; the plans tell which nodes and edges that deletes or alters. Edges
    of deleted nodes go with them and are not planned on their own.
    """
    nodes, edges = store
    fresh_nodes, fresh_edges = extract(docs.join(change.read, "doc_id", "left_semi"))
    fresh_nodes, fresh_edges = settle(fresh_nodes), settle(fresh_edges)
    node_plan = settle(delta.reconcile_rows(nodes.drop("kind"), fresh_nodes.drop("kind"), change.drop, ["id"]))  # read twice
    gone = node_plan.where("action = 'delete'").select("id")
    keys = ["src", "kind", "dst"]
    staying = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    edge_plan = delta.reconcile_rows(staying.select(*keys, "doc", "props"), fresh_edges, change.drop, keys)
    keep = lambda df: df.join(change.drop, "doc", "left_anti").select(*df.columns)
    return keep(nodes).unionByName(fresh_nodes), keep(edges).unionByName(fresh_edges), node_plan, edge_plan


#: The tables of an ingested corpus and what their rows are replaced by; said_... tell which document says what, as often as it does.
TABLES = {"manifest": ["doc_id"], "nodes": ["id"], "edges": ["src", "kind", "dst"], "said_nodes": ["doc"], "said_edges": ["doc"]}
KEYS = {"nodes": TABLES["nodes"], "edges": TABLES["edges"]}


def ingest(store: Store, docs: DataFrame, extract: Extract) -> int:
    """Ingests a corpus (doc_id, hash, ...) from nothing into a store of TABLES; the version."""
    docs = settle(docs)  # what they say is several times as large, and is made again for each use
    said = dict(zip(KEYS, extract(docs), strict=True))
    rows = {"manifest": docs.select("doc_id", "hash")}
    for name, keys in KEYS.items():
        rows[name] = merged(said[name], keys)
        rows[f"said_{name}"] = said[name].select("doc", *keys)
    return store.commit(rows, whole=True)


class Maintained:
    """What a delta between a store's manifest and docs (doc_id, hash, ...) changes in the store, worked out from the difference alone.

    rows(table), gone(table): what it gains and loses. Only the documents of the delta are extracted; merged nodes and
    edges are taken up only where such a document speaks of them, and their documents updated by
    difference. What one has lost alone is deleted; edges at deleted nodes go with them.
    `commit` writes all of it under one pointer, `after` is a table as it then is.
    """

    def __init__(self, store: Store, docs: DataFrame, extract: Extract, version: int | None = None):
        """docs are met with the manifest once, and only what differs is kept, content and all."""
        self.store, self.version = store, version
        old = store.read("manifest", version).select("doc_id", F.col("hash").alias("old_hash"))
        both = old.join(docs.withColumnRenamed("hash", "new_hash"), "doc_id", "full_outer")
        action = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed")
        changed = settle(both.withColumn("action", action).where("action is not null"))
        self.change = Delta(None, docs, changed)
        self.read = changed.where("action <> 'deleted'").withColumnRenamed("new_hash", "hash").select(*docs.columns)
        self.said = dict(zip(KEYS, extract(self.read), strict=True))
        self._found: dict[str, DataFrame] = {}

    def found(self, name: str) -> DataFrame:
        """The rows of a merged table that the delta touches, as they become."""
        if name not in self._found:
            lost = self.store.read(f"said_{name}", self.version).join(self.change.drop, "doc", "left_semi")
            self._found[name] = settle(united(self.store.read(name, self.version), self.said[name], lost, KEYS[name]))
        return self._found[name]

    def rows(self, name: str) -> DataFrame:
        """What a table gains."""
        if name == "manifest":
            return self.read.select("doc_id", "hash")
        if name in KEYS:
            return self.found(name).where("not gone").drop("gone")
        return self.said[name.removeprefix("said_")].select("doc", *KEYS[name.removeprefix("said_")])

    def gone(self, name: str) -> DataFrame:
        """The keys that a table loses."""
        if name not in KEYS:
            return self.change.drop.select(F.col("doc").alias(TABLES[name][0]))
        own = self.found(name).where("gone").select(*KEYS[name])
        if name == "nodes":
            return own
        ids, old = self.gone("nodes"), self.store.read("edges", self.version).select(*KEYS["edges"])
        beside = old.join(ids.toDF("src"), "src", "left_semi").unionByName(old.join(ids.toDF("dst"), "dst", "left_semi"))
        return own.unionByName(beside.select(*KEYS["edges"])).distinct()

    def after(self, name: str) -> DataFrame:
        """A table after the delta: the store's rows whose keys it does not touch, and its own."""
        keys, rows = self.store.keys[name], self.rows(name)
        left = self.gone(name).select(*keys).unionByName(rows.select(*keys))
        return self.store.read(name, self.version).join(left, keys, "left_anti").select(*rows.columns).unionByName(rows)

    def report(self) -> DataFrame:
        """(what, n): documents of the delta by class, and of each table rows gained, keys lost and rows that the store has."""
        one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = self.change.classified.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n"))
        for name in KEYS:
            for what, df in (("gained", self.rows(name)), ("lost", self.gone(name)), ("held", self.store.read(name, self.version))):
                out = out.unionByName(one(f"{name}_{what}", df))
        return out

    def commit(self) -> int:
        return self.store.commit({name: self.rows(name) for name in TABLES}, {name: self.gone(name) for name in TABLES})


def delta_report(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], plans: tuple[DataFrame, DataFrame], change: Delta, chunks: tuple[DataFrame, DataFrame], embedded: DataFrame) -> DataFrame:
    """(what, n): how many of each class of documents, nodes, edges and chunks before and after, orphans, and chunks embedded anew.

    Orphans are deleted nodes and those deleted edges that no deleted node takes along.
    """
    keys = ["src", "kind", "dst"]
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    orphans = plans[0].where("action = 'delete'").select(F.col("id").alias("k")).unionByName(plans[1].where("action = 'delete'").select(F.concat_ws(" ", *keys).alias("k")))
    parts = [
        change.classified.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n")),
        one("nodes_before", before[0].select("id").distinct()), one("edges_before", before[1].select(*keys).distinct()), one("chunks_before", chunks[0]),
        one("nodes_after", after[0].select("id").distinct()), one("edges_after", after[1].select(*keys).distinct()), one("chunks_after", chunks[1]),
        one("orphans", orphans), one("embedded", embedded),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chunk_delta(index: DataFrame, fresh: DataFrame, change: Delta) -> tuple[DataFrame, DataFrame]:
    """(index after, chunks that were written): chunks (doc_id, ...) of dropped documents leave the index, those of read ones enter it."""
    kept = index.join(change.drop.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti").select(*index.columns)
    written = fresh.join(change.read, "doc_id", "left_semi").select(*index.columns)
    return kept.unionByName(written), written


def staged(docs: DataFrame, cache: DataFrame, before: DataFrame, embedder_fp: str, extraction_fp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs with `work`, state): which documents' chunks come from the cache and which are embedded anew, and the state after the run.

    docs is (doc_id, hash), cache (fp, hash) of the artifacts there are. Content that is
    cached under the embedder's fingerprint is a hit, wherever it stands now: its texts and
    vectors are reused and the ids are derived from the document that has it. Another
    fingerprint makes every document a miss.
    """
    known = cache.where(F.col("fp") == embedder_fp).select("hash", F.lit("cached").alias("work")).distinct()
    found = docs.join(known, "hash", "left").withColumn("work", F.coalesce("work", F.lit("embed")))
    return found.select("doc_id", "hash", "work"), state.next_state(docs.select("doc_id", "hash"), before, embedder_fp, extraction_fp)


def cached_chunks(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, source, ordinal, text): cached pieces (hash, ordinal, text) under the documents (doc_id, hash) that have their content now."""
    rows = docs.join(pieces, "hash")
    return rows.select(F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", F.substring_index("doc_id", "/", 1).alias("source"), "ordinal", "text")


def staged_run(
    docs: DataFrame,
    before: DataFrame,
    chunks: Artifacts,
    embedder_fp: str,
    embed: Callable[[DataFrame], DataFrame],
    candidates: Artifacts | None = None,
    extraction_fp: str | None = None,
    propose: Callable[[DataFrame], DataFrame] | None = None,
    ground: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> dict[str, DataFrame | int | None]:
    """A staged run over docs (doc_id, hash, ...) from a state `before`: chunks, edges, traces, state, and how many contents were embedded and extracted.

    embed turns documents into rows (hash, ordinal, text, v), propose into candidates (hash, ordinal, ...); both see only
    content that the artifacts lack under their fingerprint. Chunks have the ids of the documents that have
    their content now. With an extractor, the candidates of every document, kept or new, are grounded: ground turns
    candidates (cid, doc, ...) into (edges, traces).
    """
    pieces, embedded = chunks.made(docs, embedder_fp, embed)
    found = pieces.select(F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", F.substring_index("doc_id", "/", 1).alias("source"), "ordinal", "text", "v")
    out = {"chunks": found, "embedded": embedded, "edges": None, "traces": None, "extracted": 0}
    if propose is not None:
        said, out["extracted"] = candidates.made(docs, extraction_fp, propose)
        cid = F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string"))
        out["edges"], out["traces"] = ground(said.withColumn("cid", cid).withColumnRenamed("doc_id", "doc"))
    out["state"] = state.next_state(docs.select("doc_id", "hash"), before, embedder_fp, extraction_fp if propose is not None else None)
    return out


def parents(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(parent_id, source, heading, tier, body, children) of chunks (chunk_id, heading, text, tier) and bodies (parent_id, body).

    Children are structs (ordinal, chunk_id, heading, text) in their order; heading and tier
    are those of the first. A parent without a body is an error.
    """
    rows = chunks.select(Q.parent_key(F.col("chunk_id")).alias("parent_id"), F.struct(Q.ordinal(F.col("chunk_id")).alias("ordinal"), "chunk_id", "heading", "text", "tier").alias("c"))
    grouped = rows.groupBy("parent_id").agg(F.array_sort(F.collect_list("c")).alias("c"), F.min("c").alias("first"))
    both = grouped.join(bodies, "parent_id", "left")
    missing = F.raise_error(F.concat(F.lit("no body for "), F.col("parent_id"))).cast("string")
    child = F.transform("c", lambda x: F.struct(x["ordinal"].alias("ordinal"), x["chunk_id"].alias("chunk_id"), x["heading"].alias("heading"), x["text"].alias("text")))
    return both.select(
        "parent_id", F.substring_index("parent_id", "/", 1).alias("source"), F.col("first.heading").alias("heading"), F.col("first.tier").alias("tier"), F.coalesce("body", missing).alias("body"), child.alias("children")
    )


def dual_write(embedded: DataFrame, bodies: DataFrame, chunk_path: str, parent_path: str) -> None:
    """Writes chunks, embedded once, to the flat table and by parent to the other one."""
    once = settle(embedded)
    once.write.mode("overwrite").parquet(chunk_path)
    parents(once, bodies).write.mode("overwrite").parquet(parent_path)


def deleted(chunks: DataFrame, by: DataFrame) -> DataFrame:
    """Chunks without those of the pairs (source, doc_path): both must agree, as paths may recur in another source."""
    return chunks.join(by.select("source", "doc_path").distinct(), ["source", "doc_path"], "left_anti").select(*chunks.columns)


def replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its rows of the keys of `rows` replaced by these exactly."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes gone (id) and the edges at either of their ends."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select(*edges.columns)
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), kept


def schema_edges(candidates: DataFrame, verdicts: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, traces) of candidates (cid, doc, span) with their verdicts (cid, predicate, rule) and grounded ends (cid, src, dst).

    Every candidate has its trace; edges carry how they were found, the document and the words that say so, and are only ever added.
    """
    rows = candidates.select("cid", "doc", "span").join(verdicts.select("cid", "predicate", "rule"), "cid").join(held, "cid", "left")
    verdict = F.coalesce("rule", F.when(F.col("src").isNull(), "ungrounded"), F.lit("accepted"))
    traced = rows.withColumn("verdict", verdict)
    edges = traced.where("verdict = 'accepted'").select("src", F.col("predicate").alias("kind"), "dst", F.lit("schema-guided-llm").alias("extraction_method"), F.col("doc").alias("source_doc"), "span")
    return edges, traced.select("cid", "verdict", "doc", "span")


def write_communities(summaries: DataFrame, members: DataFrame, root: str, refresh: bool = True) -> int | None:
    """Writes communities and the lookup from entity to community under one pointer, of a full run alone: a delta run (`refresh` false) leaves both as they are."""
    if not refresh:
        return None
    store = Store(members.sparkSession, root, {"members": ["id"], "communities": ["community"]})
    return store.commit({"members": members.select("id", "community"), "communities": summaries}, whole=True)
