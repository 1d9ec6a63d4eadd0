"""Incremental maintenance: manifests, moves, reconciliation and the content cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.state import publish, published

__all__ = ["cached", "cascaded", "diff", "moves", "publish", "published", "reconcile", "reconcile_rows", "with_moves"]


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, action, old_hash, new_hash): added, changed or deleted, by one full outer join."""
    both = before.select("doc_id", F.col("hash").alias("old_hash")).join(
        after.select("doc_id", F.col("hash").alias("new_hash")), "doc_id", "full_outer"
    )
    action = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return both.withColumn("action", action).where("action is not null")


def moves(changes: DataFrame) -> DataFrame:
    """(old_doc_id, new_doc_id, hash): deleted and added documents of one hash, paired in the order of their names."""

    def ranked(action: str, hash_col: str, name: str) -> DataFrame:
        order = Window.partitionBy(hash_col).orderBy("doc_id")
        return changes.where(F.col("action") == action).select(
            F.col(hash_col).alias("hash"), F.col("doc_id").alias(name), F.row_number().over(order).alias("n")
        )

    gone, new = ranked("deleted", "old_hash", "old_doc_id"), ranked("added", "new_hash", "new_doc_id")
    return gone.join(new, ["hash", "n"]).select("old_doc_id", "new_doc_id", "hash")


def with_moves(changes: DataFrame) -> DataFrame:
    """The delta: changes, with each move once instead of as a deletion and an addition."""
    moved = moves(changes)
    rest = (
        changes.join(moved.select(F.col("old_doc_id").alias("doc_id")), "doc_id", "left_anti")
        .join(moved.select(F.col("new_doc_id").alias("doc_id")), "doc_id", "left_anti")
        .select("action", "doc_id", F.lit(None).cast("string").alias("new_doc_id"))
    )
    return rest.unionByName(moved.select(F.lit("moved").alias("action"), F.col("old_doc_id").alias("doc_id"), "new_doc_id"))


def reconcile(store: DataFrame, scratch: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, action, docs): what a delta does to rows kept by the documents that support them.

    store and scratch are (*keys, doc); docs = store's without the removed, and scratch's.
    Rows without a document are deleted, new or altered ones upserted, others left out.
    Only keys that a removed document or the scratch touches can change, so only their rows are grouped.
    """
    gone = removed.select("doc").distinct()
    touched = store.join(gone, "doc", "left_semi").select(*keys).unionByName(scratch.select(*keys)).distinct()
    mine = store.join(touched, keys, "left_semi").join(gone.withColumn("gone", F.lit(True)), "doc", "left")
    old = mine.select(*keys, "doc", F.lit(True).alias("had"), F.col("gone").isNull().alias("has"))
    both = old.unionByName(scratch.select(*keys, "doc", F.lit(False).alias("had"), F.lit(True).alias("has")))
    docs = both.groupBy(*keys, "doc").agg(F.max("had").alias("had"), F.max("has").alias("has")).groupBy(*keys)
    found = docs.agg(
        F.array_sort(F.collect_list(F.when(F.col("has"), F.col("doc")))).alias("docs"), F.count_if("had").alias("n_had"), F.count_if(F.col("had") != F.col("has")).alias("n_changed")
    )
    action = F.when(F.size("docs") == 0, F.when(F.col("n_had") > 0, "delete")).when(F.col("n_changed") > 0, "upsert")
    return found.withColumn("action", action).where("action is not null").select(*keys, "action", "docs")


def reconcile_rows(store: DataFrame, scratch: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, action, props, docs, sources): as `reconcile`, of rows (*keys, doc, props) whose properties a delta may change.

    A row's properties in the store are those of all its rows there; the scratch's override
    them key by key, and what a lost document alone had said stays until a rebuild. sources
    are what stands before the first / of the surviving documents. Rows that neither lose nor gain anything are left out.
    """
    gone = removed.select("doc").distinct().withColumn("gone", F.lit(True))
    told = F.when(F.size("props") > 0, F.map_entries("props"))
    none = F.lit(None).cast("array<struct<key:string,value:string>>")
    old = store.select(*keys, "doc", "props").join(gone, "doc", "left")
    old = old.select(*keys, "doc", F.lit(True).alias("had"), F.col("gone").isNull().alias("has"), told.alias("was"), none.alias("now"))
    new = scratch.select(*keys, "doc", F.lit(False).alias("had"), F.lit(True).alias("has"), none.alias("was"), told.alias("now"))
    rows = old.unionByName(new).dropna(subset=keys).repartition(*keys)  # the only shuffle by keys
    found = rows.groupBy(*keys).agg(F.collect_list(F.struct("doc", "had", "has", "was", "now")).alias("rows"), F.max(~(F.col("had") & F.col("has"))).alias("touched")).where("touched")
    those = lambda flag: F.array_distinct(F.transform(F.filter("rows", lambda x: x[flag]), lambda x: x["doc"])).alias(flag)
    entries = lambda name: F.array_distinct(F.flatten(F.filter(F.transform("rows", lambda x: x[name]), lambda x: x.isNotNull()))).alias(name)
    found = found.select(*keys, those("had"), those("has"), entries("was"), entries("now"))
    most = lambda of, k: F.array_max(F.transform(F.filter(of, lambda e: e["key"] == k), lambda e: e["value"]))
    names = F.array_sort(F.array_distinct(F.transform(F.concat("was", "now"), lambda e: e["key"])))
    merged = F.transform(names, lambda k: F.struct(k.alias("k"), F.coalesce(most(F.col("now"), k), most(F.col("was"), k)).alias("v")))
    altered = F.exists(names, lambda k: most(F.col("now"), k).isNotNull() & ~most(F.col("now"), k).eqNullSafe(most(F.col("was"), k)))
    empty = F.size("has") == 0
    differ = (F.size("had") != F.size("has")) | (F.size(F.array_except("has", "had")) > 0)
    action = F.when(empty, F.when(F.size("had") > 0, "delete")).when(differ | altered, "upsert")
    out = found.withColumn("action", action).where("action is not null")
    out = out.select(*keys, "action", F.when(F.size(merged) > 0, F.map_from_entries(merged)).alias("props"), F.when(~empty, F.array_sort("has")).alias("docs"))
    sources = F.array_sort(F.array_distinct(F.transform("docs", lambda x: F.substring_index(x.cast("string"), "/", 1))))
    return out.select("*", sources.alias("sources"))


def cascaded(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges (src, kind, dst) that go with deleted nodes (id): those that leave them, and of the rest those that reach them."""
    ids = gone.select("id").distinct()
    out = edges.join(ids.toDF("src"), "src", "left_semi").select(*edges.columns)
    into = edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_semi").select(*edges.columns)
    return out.unionByName(into)


def cached(current: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of documents (doc_id, fp, hash) in a cache by fingerprint and content."""
    keys = cache.select("fp", "hash").distinct()
    return current.join(keys, ["fp", "hash"], "left_semi"), current.join(keys, ["fp", "hash"], "left_anti")
