"""An ingest corpus derived from the tables: one document for each nation, supplier and part, before and after a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.sources.graph import table, tier_of
from weftspark.sources.org import sig_of


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, key, title, owner, authors): charters of groups, pages of people with the group they lead, proposals with owner and authors."""
    none = F.array().cast("array<bigint>")
    read = lambda name: table(spark, sf_dir, name)
    doc = lambda prefix, key: F.concat(F.lit(prefix), F.lpad(key.cast("string"), 8, "0"))
    wrote = read("lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("authors"))
    parts = [
        read("nation").select(doc("community/sig-", F.col("n_nationkey")).alias("doc_id"), F.lit("sig").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("title"), F.lit(None).cast("long").alias("owner"), none.alias("authors")),
        read("supplier").select(doc("community/person-", F.col("s_suppkey")).alias("doc_id"), F.lit("person").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("long").alias("owner"), none.alias("authors")),
        read("part").join(wrote, F.col("p_partkey") == F.col("p"), "left").select(
            doc("enhancements/kep-", F.col("p_partkey")).alias("doc_id"), F.lit("kep").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), (F.col("p_partkey") % 25).alias("owner"), F.coalesce("authors", none).alias("authors")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Divisors of the keys of documents that a change deletes, edits, moves and adds: of about a quarter of the corpus, and of about a twentieth.
LARGE, SMALL = (17, 11, 13, 19), (103, 37, 79, 101)


def after(docs: DataFrame, divisors: tuple[int, int, int, int] = LARGE) -> DataFrame:
    """The corpus after a change: documents of keys with the first divisor are gone, with the second edited, with the third under another name; each key with the fourth has a new one."""
    gone, edit, move, new = divisors
    key, of = F.col("key"), F.col("kind") == "kep"
    edited = (key % edit == 0) & of
    row = lambda doc_id, key, title, owner, authors: F.struct(doc_id.alias("doc_id"), F.col("kind"), key.alias("key"), title.alias("title"), owner.alias("owner"), authors.alias("authors"))
    own = [F.col(c) for c in ("title", "owner", "authors")]
    kept = row(
        F.when((key % move == 0) & of, F.concat("doc_id", F.lit("-moved"))).otherwise(F.col("doc_id")), key, F.when(edited, F.concat("title", F.lit(" (revised)"))).otherwise(own[0]),
        F.when(edited, (F.col("owner") + 1) % 25).otherwise(own[1]), F.when(edited, F.slice("authors", 1, 1)).otherwise(own[2]),
    )
    fresh = row(F.concat("doc_id", F.lit("-new")), key + 10_000_000, *own)
    rows = F.array(F.when((key % gone != 0) | (F.col("kind") == "sig"), kept), F.when((key % new == 0) & of, fresh))  # docs are worked out once
    return docs.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def hashed(docs: DataFrame) -> DataFrame:
    """docs with the hash of their content."""
    return docs.withColumn("hash", F.sha2(F.concat_ws("|", "kind", F.col("key").cast("string"), "title", F.coalesce(F.col("owner").cast("string"), F.lit("-")), F.array_join(F.transform("authors", lambda a: a.cast("string")), ",")), 256))


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): rows (id, kind, doc, props) and (src, kind, dst, doc, props), what each document says by itself."""
    person = lambda key: F.concat(F.lit("person:supplier"), key.cast("string"))
    own = F.when(F.col("kind") == "sig", sig_of(F.col("key"))).when(F.col("kind") == "person", person(F.col("key"))).otherwise(T.numbered(F.col("key").cast("string")))
    empty = F.create_map().cast("map<string,string>")
    told = docs.withColumn("own", own).withColumn("sig", F.when(F.col("owner").isNotNull(), sig_of(F.col("owner")))).withColumn("doc", F.col("doc_id"))
    node = lambda id_, kind, props=empty: F.struct(id_.alias("id"), kind.alias("kind"), props.alias("props"))
    edge = lambda src, kind, dst: F.struct(src.alias("src"), kind.alias("kind"), dst.alias("dst"))
    some = lambda *rows: F.filter(F.array(*rows), lambda x: x.isNotNull())
    each = lambda make: F.coalesce(F.transform("authors", make), F.array())
    has = F.col("sig").isNotNull()
    said = F.concat(
        some(node(F.col("own"), F.col("kind"), F.create_map(F.lit("title"), F.col("title"))), F.when(has, node(F.col("sig"), F.lit("sig")))),
        each(lambda a: node(person(a), F.lit("person"))),
    )
    lead = F.when(F.col("key") % 3 == 0, "CHAIRS").otherwise("TECH_LEADS")
    linked = F.concat(
        some(
            F.when(has & (F.col("kind") == "kep"), edge(F.col("sig"), F.lit("OWNS"), F.col("own"))),
            F.when(has & (F.col("kind") == "person"), edge(F.col("own"), lead, F.col("sig"))),
        ),
        each(lambda a: edge(person(a), F.lit("AUTHORS"), F.col("own"))),
    )
    # One pass over the documents for each of the two: what makes these would run once for each kind of row.
    nodes = told.select("doc", F.inline(said)).select("id", "kind", "doc", "props")
    return nodes, told.select("doc", F.inline(linked)).select("src", "kind", "dst", "doc", empty.alias("props"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tier): the tiers of the proposals that are not public."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(T.numbered(F.col("p_partkey").cast("string")).alias("id"), tier_of(F.col("p_partkey")).alias("tier"))


_DOC = "lpad({k}::VARCHAR, 8, '0')"


def ledger_sql(divisors: tuple[int, int, int, int] = LARGE) -> str:
    """SQL of the corpus before (`was`) and after (`now`) a change."""
    gone, edit, move, new = divisors
    return f"""wrote AS (SELECT l_partkey AS p, list_sort(list(DISTINCT l_suppkey)) AS authors FROM lineitem GROUP BY l_partkey),
was AS (SELECT 'community/sig-' || {_DOC.format(k='n_nationkey')} AS doc_id, 'sig' AS kind, n_nationkey::BIGINT AS key, n_name AS title, NULL::BIGINT AS owner, []::BIGINT[] AS authors FROM nation
  UNION ALL SELECT 'community/person-' || {_DOC.format(k='s_suppkey')}, 'person', s_suppkey, s_name, s_nationkey::BIGINT, []::BIGINT[] FROM supplier
  UNION ALL SELECT 'enhancements/kep-' || {_DOC.format(k='p_partkey')}, 'kep', p_partkey, p_name, p_partkey % 25, coalesce(authors, []::BIGINT[]) FROM part LEFT JOIN wrote ON p = p_partkey),
now AS (SELECT CASE WHEN key % {move} = 0 AND kind = 'kep' THEN doc_id || '-moved' ELSE doc_id END AS doc_id, kind, key, CASE WHEN key % {edit} = 0 AND kind = 'kep' THEN title || ' (revised)' ELSE title END AS title,
    CASE WHEN key % {edit} = 0 AND kind = 'kep' THEN (owner + 1) % 25 ELSE owner END AS owner, CASE WHEN key % {edit} = 0 AND kind = 'kep' THEN authors[1:1] ELSE authors END AS authors FROM was WHERE key % {gone} <> 0 OR kind = 'sig'
  UNION ALL SELECT doc_id || '-new', kind, key + 10000000, title, owner, authors FROM was WHERE key % {new} = 0 AND kind = 'kep')"""


LEDGER_SQL = ledger_sql()


def said_sql(name: str, of: str) -> str:
    """SQL of the node and edge rows that the documents of a table say: <name>_n (id, kind, doc, title) and <name>_e (src, kind, dst, doc)."""
    own = "CASE kind WHEN 'sig' THEN 'sig:sig-nation-' || key WHEN 'person' THEN 'person:supplier' || key ELSE 'kep-' || key END"
    return f"""{name}_n AS (SELECT {own} AS id, kind, doc_id AS doc, title FROM {of} UNION ALL SELECT 'sig:sig-nation-' || owner, 'sig', doc_id, NULL FROM {of} WHERE owner IS NOT NULL
  UNION ALL SELECT 'person:supplier' || unnest(authors), 'person', doc_id, NULL FROM {of}),
{name}_e AS (SELECT 'sig:sig-nation-' || owner AS src, 'OWNS' AS kind, 'kep-' || key AS dst, doc_id AS doc FROM {of} WHERE kind = 'kep' AND owner IS NOT NULL
  UNION ALL SELECT 'person:supplier' || key, CASE WHEN key % 3 = 0 THEN 'CHAIRS' ELSE 'TECH_LEADS' END, 'sig:sig-nation-' || owner, doc_id FROM {of} WHERE kind = 'person' AND owner IS NOT NULL
  UNION ALL SELECT 'person:supplier' || unnest(authors), 'AUTHORS', {own}, doc_id FROM {of})"""
