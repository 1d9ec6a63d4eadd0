"""The property graph, mentions, manifests and quads that the operators run on, derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ["public", "internal", "restricted"]
TYPES = ["Policy", "Standard", "Guideline", "SOP", "Concept", "Transcript"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def tier_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), (key % 3 + 1).cast("int"))


def _kinds(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, Column, Column, Column]]:
    read = lambda name: table(spark, sf_dir, name)
    public = F.lit("public")
    return [
        ("region", read("region"), F.col("r_regionkey"), F.col("r_name"), public),
        ("nation", read("nation"), F.col("n_nationkey"), F.col("n_name"), tier_of(F.col("n_nationkey"))),
        ("customer", read("customer"), F.col("c_custkey"), F.col("c_name"), tier_of(F.col("c_custkey"))),
        ("supplier", read("supplier"), F.col("s_suppkey"), F.col("s_name"), tier_of(F.col("s_suppkey"))),
        ("part", read("part"), F.col("p_partkey"), F.col("p_name"), public),
        ("order", read("orders"), F.col("o_orderkey"), F.col("o_orderstatus"), public),
        *(
            (kind, read(of).where(F.col(key).isNotNull()).select(key).distinct(), F.col(key), F.col(key).cast("string"), public)
            for kind, of, key in (("user", "events", "user_id"), ("event_type", "events", "event_type"), ("source", "documents", "source"), ("lang", "documents", "lang"))
        ),
    ]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, tier)."""
    parts = [
        df.select(node_id(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), tier.alias("tier"))
        for kind, df, key, name, tier in _kinds(spark, sf_dir)
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(src, kind, dst), each edge once; or as often as rows tell it, for readers that deduplicate what they pick."""
    read = lambda name: table(spark, sf_dir, name)
    pairs = lambda df, *keys: df.select(*keys).distinct() if once else df.select(*keys)

    def edge(df: DataFrame, src: tuple[str, str], kind: str, dst: tuple[str, str]) -> DataFrame:
        return df.select(
            node_id(src[0], F.col(src[1])).alias("src"), F.lit(kind).alias("kind"), node_id(dst[0], F.col(dst[1])).alias("dst")
        )

    lines = read("lineitem")
    return reduce(
        DataFrame.unionByName,
        [
            edge(read("nation"), ("nation", "n_nationkey"), "IN_REGION", ("region", "n_regionkey")),
            edge(read("customer"), ("customer", "c_custkey"), "IN_NATION", ("nation", "c_nationkey")),
            edge(read("supplier"), ("supplier", "s_suppkey"), "IN_NATION", ("nation", "s_nationkey")),
            edge(read("orders"), ("customer", "o_custkey"), "PLACED", ("order", "o_orderkey")),
            edge(pairs(lines, "l_orderkey", "l_partkey"), ("order", "l_orderkey"), "CONTAINS", ("part", "l_partkey")),
            edge(pairs(lines, "l_suppkey", "l_partkey"), ("supplier", "l_suppkey"), "SUPPLIES", ("part", "l_partkey")),
            edge(pairs(read("events"), "user_id", "event_type"), ("user", "user_id"), "DID", ("event_type", "event_type")),
        ],
    )


PG_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, 'public' AS tier FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, (['public','internal','restricted'])[n_nationkey % 3 + 1] FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, (['public','internal','restricted'])[c_custkey % 3 + 1] FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, (['public','internal','restricted'])[s_suppkey % 3 + 1] FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'public' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus, 'public' FROM orders
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'user', user_id::VARCHAR, 'public' FROM events WHERE user_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'event_type:' || event_type, 'event_type', event_type, 'public' FROM events WHERE event_type IS NOT NULL
  UNION ALL SELECT DISTINCT 'source:' || source, 'source', source, 'public' FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT DISTINCT 'lang:' || lang, 'lang', lang, 'public' FROM documents WHERE lang IS NOT NULL),
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'IN_REGION' AS kind, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'DID', 'event_type:' || event_type FROM events),
ranked AS (SELECT id, list_position(['public','internal','restricted'], tier) AS r FROM nodes),
adj AS (
  SELECT e.src, e.dst, e.kind, '>' AS dir, greatest(a.r, b.r) AS r FROM edges e JOIN ranked a ON a.id = e.src JOIN ranked b ON b.id = e.dst
  UNION ALL SELECT e.dst, e.src, e.kind, '<', greatest(a.r, b.r) FROM edges e JOIN ranked a ON a.id = e.src JOIN ranked b ON b.id = e.dst)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, s, p, o, o_type) of documents: type, name, scope, effectiveDate (not for every seventh), hasPII."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 6 + 1).cast("int"))
    graph = F.when(F.col("doc_id") % 6 < 3, "normative").otherwise("descriptive")
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")
    facts = [
        ("type", kind, "iri"),
        ("name", F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "string"),
        ("scope", F.col("source"), "string"),
        ("effectiveDate", F.when(F.col("doc_id") % 7 != 0, day), "date"),
        ("hasPII", F.col("text").rlike(EMAIL).cast("string"), "boolean"),
    ]
    return (
        docs.select(
            graph.alias("g"),
            F.concat(F.lit("urn:doc:"), F.col("source"), F.lit(":"), F.col("doc_id").cast("string")).alias("s"),
            F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(t).alias("o_type")) for p, o, t in facts])).alias("f"),
        )
        .select("g", "s", "f.*")
        .where("o is not null")
    )


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

QUADS_SQL = r"""docs AS (
  SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN 'normative' ELSE 'descriptive' END AS g, 'urn:doc:' || source || ':' || doc_id AS s,
         (['Policy','Standard','Guideline','SOP','Concept','Transcript'])[doc_id % 6 + 1] AS type, 'Document ' || doc_id AS name, source AS scope,
         CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2023-01-01' + (doc_id % 900)::INT, '%Y-%m-%d') END AS day,
         CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'true' ELSE 'false' END AS pii FROM documents),
quads AS (
  SELECT g, s, 'type' AS p, type AS o, 'iri' AS o_type FROM docs UNION ALL SELECT g, s, 'name', name, 'string' FROM docs
  UNION ALL SELECT g, s, 'scope', scope, 'string' FROM docs UNION ALL SELECT g, s, 'effectiveDate', day, 'date' FROM docs WHERE day IS NOT NULL
  UNION ALL SELECT g, s, 'hasPII', pii, 'boolean' FROM docs)"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after), each (doc_id, hash): after lacks every 17th, has every 11th edited, every 13th renamed and copies of every 19th."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    before = docs.select(name.alias("doc_id"), F.sha2("text", 256).alias("hash"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    renamed = F.when(F.col("doc_id") % 13 == 0, F.concat(name, F.lit("-moved"))).otherwise(name)
    after = docs.where("doc_id % 17 <> 0").select(renamed.alias("doc_id"), F.sha2(edited, 256).alias("hash"))
    copies = docs.where("doc_id % 19 = 0").select(F.concat(name, F.lit("-copy")).alias("doc_id"), F.sha2("text", 256).alias("hash"))
    return before, after.unionByName(copies)


MANIFEST_SQL = """prev AS (SELECT source || '/' || doc_id AS doc_id, sha256(text) AS hash FROM documents),
cur AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN source || '/' || doc_id || '-moved' ELSE source || '/' || doc_id END AS doc_id,
         sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0
  UNION ALL SELECT source || '/' || doc_id || '-copy', sha256(text) FROM documents WHERE doc_id % 19 = 0)"""
