"""An organisation derived from the tables: groups (nations), proposals (parts), people (suppliers), and questions about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.sources.graph import table, tier_of


def sig_of(key: Column) -> Column:
    return T.sig_id(F.concat(F.lit("NATION_"), key.cast("string")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, title, tier): sig, kep and person."""
    read = lambda name: table(spark, sf_dir, name)
    parts = [
        read("nation").select(T.sig_id(F.col("n_name")).alias("id"), F.lit("sig").alias("kind"), F.col("n_name").alias("title"), tier_of(F.col("n_nationkey")).alias("tier")),
        read("part").select(T.numbered(F.col("p_partkey").cast("string")).alias("id"), F.lit("kep").alias("kind"), F.col("p_name").alias("title"), tier_of(F.col("p_partkey")).alias("tier")),
        read("supplier").select(
            F.concat(F.lit("person:supplier"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("person").alias("kind"), F.col("s_name").alias("title"), tier_of(F.col("s_suppkey")).alias("tier")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(src, kind, dst): OWNS sig > kep, CHAIRS and TECH_LEADS person > sig, AUTHORS person > kep, each once; or as often as rows tell it, for readers that deduplicate what they pick."""
    person = F.concat(F.lit("person:supplier"), F.col("s_suppkey").cast("string"))
    lead = F.when(F.col("s_suppkey") % 3 == 0, "CHAIRS").otherwise("TECH_LEADS")
    owns = table(spark, sf_dir, "part").select(sig_of(F.col("p_partkey") % 25).alias("src"), F.lit("OWNS").alias("kind"), T.numbered(F.col("p_partkey").cast("string")).alias("dst"))
    leads = table(spark, sf_dir, "supplier").select(person.alias("src"), lead.alias("kind"), sig_of(F.col("s_nationkey")).alias("dst"))
    wrote = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    wrote = (wrote.distinct() if once else wrote).select(
        F.concat(F.lit("person:supplier"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("AUTHORS").alias("kind"), T.numbered(F.col("l_partkey").cast("string")).alias("dst")
    )
    return owns.unionByName(leads).unionByName(wrote)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, handle): display names in lower case."""
    return table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("alias"), F.concat(F.lit("@Supplier"), F.col("s_suppkey").cast("string")).alias("handle"))


#: What a question opens with, by its number; {n}, {p}, {s} are keys of a nation, a part and a supplier, not all of which exist.
OPENINGS = [
    "Which KEPs does SIG Nation-{n} own? ",
    "Who are the tech leads of sig-nation_{n}? ",
    "Does @Supplier{s} lead or chair a SIG? ",
    "Which SIG owns KEP-{p}? ",
    "Summarize the themes across all groups. ",
    "How many are related to urn:doc:{p}? ",
    "Is urn:doc:{p} related to biz:policy-{n}? ",
    "What do the enhancements and KEP {p} and kep{p} say overall, by @supplier{s}? ",
    "Does Supplier#{z} tech lead SIG Nation-{n} in the community? ",
    "",
    "Tell me about urn:doc:{n} and urn:doc:{p}. ",
    "Nation-{n} SIG and SIG Nation-{n}: the top 7 or 12 of KEP-00{p}, in review. ",
    "An overview of the landscape, broadly. ",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, n, question): what users say in conversations, after an opening that names entities."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    number = F.pmod(F.col("conv_id") * 5 + F.col("turn") * 3, F.lit(len(OPENINGS))).cast("int")
    keys = {"n": F.col("conv_id") % 25, "p": (F.col("conv_id") * 7 + F.col("turn")) % 2500, "s": F.col("conv_id") % 120, "z": F.lpad((F.col("conv_id") % 120).cast("string"), 9, "0")}

    def opening(text: str) -> Column:
        out = F.lit(text)
        for name, key in keys.items():
            out = F.replace(out, F.lit("{" + name + "}"), key.cast("string")) if "{" + name + "}" in text else out
        return out

    chosen = F.element_at(F.array(*[opening(t) for t in OPENINGS]), number + 1)
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), number.alias("n"), F.concat(chosen, F.coalesce("text", F.lit(""))).alias("question"))


def _opening_sql(text: str) -> str:
    out = "'" + text + "'"
    for name, key in {"n": "conv_id % 25", "p": "(conv_id * 7 + turn) % 2500", "s": "conv_id % 120", "z": "lpad((conv_id % 120)::VARCHAR, 9, '0')"}.items():
        if "{" + name + "}" in text:
            out = f"replace({out}, '{{{name}}}', ({key})::VARCHAR)"
    return out


QUESTIONS_SQL = f"""q AS (SELECT conv_id || ':' || turn AS qid, (conv_id * 5 + turn * 3) % {len(OPENINGS)} AS n,
  ([{', '.join(_opening_sql(t) for t in OPENINGS)}])[(conv_id * 5 + turn * 3) % {len(OPENINGS)} + 1] || coalesce(text, '') AS question FROM conversations WHERE role = 'user')"""

ORG_SQL = """nodes AS (
  SELECT 'sig:sig-nation-' || n_nationkey AS id, 'sig' AS kind, n_name AS title, n_nationkey % 3 + 1 AS r FROM nation
  UNION ALL SELECT 'kep-' || p_partkey, 'kep', p_name, p_partkey % 3 + 1 FROM part
  UNION ALL SELECT 'person:supplier' || s_suppkey, 'person', s_name, s_suppkey % 3 + 1 FROM supplier),
edges AS (
  SELECT 'sig:sig-nation-' || (p_partkey % 25) AS src, 'OWNS' AS kind, 'kep-' || p_partkey AS dst FROM part
  UNION ALL SELECT 'person:supplier' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'CHAIRS' ELSE 'TECH_LEADS' END, 'sig:sig-nation-' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'person:supplier' || l_suppkey, 'AUTHORS', 'kep-' || l_partkey FROM lineitem)"""
