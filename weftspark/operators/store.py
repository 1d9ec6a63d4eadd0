"""Tables that a run changes together: kept in generations, read under one pointer.

A run writes what it adds and the keys of what it removes as a generation of each table
that it changes; nothing written before is rewritten. One pointer row, written last,
names the generations that belong together, so a run that dies leaves the state before
it, of all tables. Removed rows are left out when a table is read, until a
compaction writes it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.state import settle

POINTER = T.StructType([T.StructField("version", T.LongType()), T.StructField("tables", T.MapType(T.StringType(), T.ArrayType(T.LongType())))])


class Store:
    """Tables in the folder `root`, which all executors share; keys: for each table the columns by which its rows are replaced or removed.

    One writer at a time. A reader that holds a version sees its tables as they were then, whatever later runs do.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]]):
        self.spark, self.root, self.keys = spark, root, keys

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def pointer(self, version: int | None = None) -> tuple[int, dict[str, list[int]]]:
        """(version, generations of each table) of the newest run, or of the one that is named; 0 and none before the first."""
        if not self._exists(f"{self.root}/pointer"):
            return 0, {}
        rows = self.spark.read.schema(POINTER).json(f"{self.root}/pointer")
        row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        return (0, {}) if row is None else (row["version"], dict(row["tables"]))

    def _point(self, version: int, tables: dict[str, list[int]]) -> None:
        row = self.spark.createDataFrame([(version, tables)], POINTER)
        row.coalesce(1).write.mode("append").json(f"{self.root}/pointer")

    def commit(self, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, whole: bool = False) -> int:
        """Writes rows of some tables and the keys of rows that go, then points to them; the new version.

        Rows replace those with their keys; whole: they are all that the tables named hold. Keys in `gone` may be
        any of a table's rows' columns that are named in its keys.
        """
        version, tables = self.pointer()
        version += 1
        rows, gone = rows or {}, gone or {}
        tables = {name: list(found) for name, found in tables.items()}
        for name in dict.fromkeys([*rows, *gone]):
            at = f"{self.root}/{name}/v={version}"
            if name in rows:
                rows[name].write.mode("overwrite").parquet(f"{at}/rows")
            leaving = [df.select(*self.keys[name]) for df in (gone.get(name), None if whole or name not in rows else self.spark.read.parquet(f"{at}/rows")) if df is not None]
            if leaving and not whole and tables.get(name):
                keys = leaving[0] if len(leaving) == 1 else leaving[0].unionByName(leaving[1])
                keys.distinct().write.mode("overwrite").parquet(f"{at}/gone")
            tables[name] = [version] if whole else [*tables.get(name, []), version]
        self._point(version, tables)
        return version

    def _generation(self, name: str, generations: list[int], what: str) -> list[DataFrame]:
        paths = [(v, f"{self.root}/{name}/v={v}/{what}") for v in generations]
        return [self.spark.read.parquet(path).withColumn("_v", F.lit(v)) for v, path in paths if self._exists(path)]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table; a table that was never written is an error."""
        generations = self.pointer(version)[1].get(name)
        if generations is None:
            raise FileNotFoundError(f"no {name} in {self.root}")
        held = self._generation(name, generations, "rows")
        if not held:
            raise FileNotFoundError(f"no rows of {name} in {self.root}")
        rows = held[0]
        for part in held[1:]:
            rows = rows.unionByName(part)
        gone = self._generation(name, generations, "gone")
        if gone:
            keys = self.keys[name]
            left = gone[0]
            for part in gone[1:]:
                left = left.unionByName(part)
            last = left.groupBy(*keys).agg(F.max("_v").alias("_gone"))
            renamed = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_gone")
            same = None
            for i, k in enumerate(keys):
                one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
                same = one if same is None else same & one
            rows = rows.join(renamed, same & (F.col("_v") < F.col("_gone")), "left_anti")
        return rows.drop("_v")

    def count(self, name: str) -> int:
        """How many rows a table has; -1 if it can't be told."""
        try:
            return self.read(name).count()
        except FileNotFoundError:
            return -1

    def clear(self, *names: str) -> int:
        """Empties tables, all of them in one version; they keep their columns."""
        return self.commit({name: self.read(name).limit(0) for name in names}, whole=True)

    def compact(self, *names: str) -> int:
        """Writes tables anew as one generation each, without what has gone; readers of older versions are not touched."""
        return self.commit({name: self.read(name) for name in names}, whole=True)


def united(old: DataFrame, fresh: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, kind?, docs, sources, props, gone) of the rows that a delta touches, from what the store says of them and the difference alone.

    old is a merged table (*keys, docs, props, ...) - only its touched rows are taken up -, fresh rows are (*keys, doc, props),
    lost pairs (*keys, doc) that go. docs: those before, without the lost and with the fresh ones. props: those before, the
    fresh ones over them. gone: whether no document is left.
    """
    facts = [] if "kind" in keys else ["kind"]
    pairs = fresh.groupBy(*keys).agg(F.collect_set("doc").alias("_new"), *[F.min(c).alias(f"_{c}") for c in facts])
    said = fresh.select(*keys, "doc", F.explode("props").alias("k", "v")).groupBy(*keys, "k").agg(F.min_by("v", "doc").alias("v"))
    said = said.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_props"))
    left = lost.groupBy(*keys).agg(F.collect_set("doc").alias("_lost"))
    touched = pairs.join(said, keys, "left").join(left, keys, "full")
    rows = touched.join(old.select(*keys, "docs", "props", *facts), keys, "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none)
    docs = F.array_sort(F.array_union(F.array_except(some("docs"), some("_lost")), some("_new")))
    empty = F.create_map().cast("map<string,string>")
    before, now = F.coalesce("props", empty), F.coalesce("_props", empty)
    props = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(now, k)), now)
    props = F.map_from_entries(F.array_sort(F.map_entries(props)))
    out = rows.select(*keys, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in facts], docs.alias("docs"), props.alias("props"))
    sources = F.array_sort(F.array_distinct(F.transform("docs", lambda x: F.substring_index(x, "/", 1))))
    return out.select(*keys, *facts, "docs", sources.alias("sources"), "props", (F.size("docs") == 0).alias("gone"))


class Artifacts:
    """What was computed once of a document's content, kept by what made it: `root`/fp=<fingerprint>/..., each row with the hash of its content.

    Another fingerprint is another partition, so nothing of it is a hit; runs add only what is missing.
    """

    def __init__(self, spark: SparkSession, root: str, shape: T.StructType):
        """shape: the columns of an artifact's rows beside `hash` and `ordinal`, their place in it."""
        self.spark, self.root = spark, root
        self.shape = T.StructType([T.StructField("hash", T.StringType()), T.StructField("ordinal", T.IntegerType()), *shape.fields])

    def of(self, fp: str) -> DataFrame:
        """The rows kept under fp; one without an ordinal stands for content of which nothing came out."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/fp={fp}")
        if not found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found):
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(f"{self.root}/fp={fp}")

    def made(self, docs: DataFrame, fp: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """(doc_id, hash and the rows of its artifact; how many contents were computed) of docs (doc_id, hash, ...): `make` turns documents into rows (hash, ordinal, ...).

        Only content that is not kept under fp is computed, once however many documents have it, and is kept before
        anything is returned. So documents of equal content share artifacts, moved ones too, and a second run computes and writes nothing.
        """
        kept = self.of(fp).select("hash").distinct()
        missing = settle(docs.join(kept, "hash", "left_anti").dropDuplicates(["hash"]))
        n = missing.count()
        if n:
            missing.select("hash").join(make(missing), "hash", "left").select(*self.shape.names).write.mode("append").parquet(f"{self.root}/fp={fp}")
        return docs.select("doc_id", "hash").join(self.of(fp).where("ordinal is not null"), "hash"), n
