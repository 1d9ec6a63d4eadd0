"""A corpus of group charters and proposals read from folders of YAML and Markdown files, and its nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import documents as D
from weftspark.functions import text as T

COMMUNITY, ENHANCEMENTS = "community", "enhancements"
# Fixed value: the line of a proposal without YAML that names its authors.
AUTHORS = r"(?imd)^\**\s*authors?\**\s*:\s*(.+?)\s*$"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all YAML and Markdown files under root; paths are relative to it."""
    root = root.rstrip("/")
    local = re.sub(r"^[a-z0-9]+:/+", "/", root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,md}").load(root)
    at = F.instr("path", local + "/")
    return raw.select(F.substr("path", at + len(local) + 1).alias("path"), F.decode("content", "UTF-8").alias("text"))


def community(spark: SparkSession, root: str) -> DataFrame:
    """(source, path, kind, ord, payload, text): the index of groups and the charter of each group it lists, in its order.

    A missing index is an error; entries without `dir` are skipped. payload is JSON.
    """
    found = files(spark, root)
    index = found.where("path = 'sigs.yaml'").withColumn("payload", D.yaml_json("text"))
    if index.isEmpty():
        raise FileNotFoundError(f"no sigs.yaml in {root}")
    listed = index.select(F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.sigs", "array<variant>")).alias("pos", "entry"))
    listed = listed.select("pos", F.try_variant_get("entry", "$.dir", "string").alias("dir")).where("dir is not null")
    listed = listed.groupBy("dir").agg(F.min("pos").alias("pos"))
    charters = listed.join(found, F.concat("dir", F.lit("/README.md")) == F.col("path"))
    order = lambda a, b, c: F.struct(F.lit(a).alias("source"), b.cast("string").alias("place"), F.lit(c).alias("file"))
    return index.select(F.lit(COMMUNITY).alias("source"), "path", F.lit("sigs_index").alias("kind"), order(0, F.lit(""), 0).alias("ord"), "payload", "text").unionByName(
        charters.select(
            F.lit(COMMUNITY).alias("source"), "path", F.lit("sig_readme").alias("kind"), order(0, F.lpad(F.col("pos").cast("string"), 12, "0"), 1).alias("ord"),
            F.to_json(F.struct(F.col("dir").alias("slug"))).alias("payload"), "text",
        )
    )


def _proposals(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root).where(F.col("path").rlike(r"^keps/[^/]+/[^/]+/(kep\.yaml|README\.md)$")).select(
        "path", "text", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.substring_index("path", "/", -1).alias("file"),
        F.nullif(F.regexp_extract("path", r"^keps/[^/]+/([0-9]+)-", 1), F.lit("")).alias("number"), F.split_part("path", F.lit("/"), F.lit(2)).alias("owner"),
    )


def enhancements(spark: SparkSession, root: str) -> DataFrame:
    """Rows as of `community`: the YAML and the text of each numbered proposal folder, folders in order, YAML first."""
    found = _proposals(spark, root).where("number is not null")
    with_yaml = found.where("file = 'kep.yaml'").select("dir", F.lit(True).alias("has"))
    found = found.join(with_yaml, "dir", "left").withColumn("has_kep_yaml", F.coalesce("has", F.lit(False)))
    own = F.to_json(F.struct(F.col("owner").alias("owning_sig_dir"), F.col("number").alias("dir_number"), "has_kep_yaml"))
    return found.select(
        F.lit(ENHANCEMENTS).alias("source"), "path", F.when(F.col("file") == "kep.yaml", "kep_yaml").otherwise("kep_readme").alias("kind"),
        F.struct(F.lit(1).alias("source"), F.col("dir").alias("place"), F.when(F.col("file") == "kep.yaml", 0).otherwise(1).alias("file")).alias("ord"),
        own.alias("payload"), "text",
    )


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """Proposal folders without a number."""
    return _proposals(spark, root).where("number is null").select("dir").distinct()


def corpus(spark: SparkSession, community_root: str, enhancements_root: str) -> DataFrame:
    """Both sources with their doc_id; `ord` is the order in which the first writer of a property wins."""
    both = community(spark, community_root).unionByName(enhancements(spark, enhancements_root))
    return both.withColumn("doc_id", F.concat_ws("/", "source", "path"))


def _group(slug: Column) -> Column:
    bare = T.slug(slug)
    return F.when(bare.startswith("sig-"), bare).otherwise(F.concat(F.lit("sig-"), bare))


def _sig(slug: Column) -> Column:
    return F.concat(F.lit("sig:"), _group(slug))


def extract(docs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that docs (as of `corpus`) state, each with its doc_id, source and ord; aliases (alias, handle) in lower case.

    Nodes have id, kind and props (null values left out), edges src, dst and kind. Entries
    that do not conform are skipped; a person of whom no handle is left is none.
    """
    tag = ["doc_id", "source", "ord"]
    told = F.create_map().cast("map<string,string>")
    props = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    node = lambda df, id_, kind, p=told: df.select(*tag, id_.alias("id"), F.lit(kind).alias("kind"), p.alias("props"))
    edge = lambda df, a, b, kind: df.select(*tag, a.alias("src"), b.alias("dst"), kind.alias("kind"))
    text = lambda column, path: F.try_variant_get(column, f"$.{path}", "string")
    several = lambda column, path, kind="variant": F.try_variant_get(column, f"$.{path}", f"array<{kind}>")
    yaml = lambda column: F.try_parse_json(D.yaml_json(column))
    docs = docs.withColumn("payload", F.try_parse_json("payload"))  # one parse of each document; fields are read from the variant

    # the index: groups, their leads and their subprojects
    index = docs.where("kind = 'sigs_index'").select(*tag, F.explode(several("payload", "sigs")).alias("entry"))
    index = index.withColumn("slug", text("entry", "dir")).where("slug is not null").withColumn("sig", _sig(F.col("slug")))
    role = lambda kind, members: F.transform(members, lambda m: F.struct(F.lit(kind).alias("kind"), text(m, "github").alias("who"), text(m, "name").alias("name")))
    leads = index.select(*tag, "sig", F.explode(F.array(role("CHAIRS", several("entry", "leadership.chairs")), role("TECH_LEADS", several("entry", "leadership.tech_leads")))).alias("m"))
    leads = leads.select(*tag, F.col("sig").alias("at"), F.inline("m")).where("who is not null")
    subs = index.select(*tag, "slug", "sig", F.explode(several("entry", "subprojects")).alias("s"))
    subs = subs.withColumn("name", text("s", "name")).where("name is not null")
    sub_id = F.concat(F.lit("subproject:"), _group(F.col("slug")), F.lit("/"), T.slug(F.col("name")))

    # charters
    charters = docs.where("kind = 'sig_readme'").select(*tag, text("payload", "slug").alias("slug"), yaml(D.markdown(F.col("text"))["block"]).alias("front"))

    # proposals with YAML: the folder's number counts only where the YAML states none
    keps = docs.where("kind = 'kep_yaml'").select(*tag, "payload", yaml("text").alias("y"))
    number = F.coalesce(text("y", "kep-number"), text("payload", "dir_number"))  # a null number counts as none
    keps = keps.select(
        *tag, "y", T.numbered(number).alias("kep"), F.coalesce(F.nullif(text("y", "owning-sig"), F.lit("")), text("payload", "owning_sig_dir")).alias("owner"),
    )
    people = keps.select(*tag, "kep", several("y", "authors", "string").alias("a"), several("y", "approvers", "string").alias("b"))
    people = people.select(*tag, "kep", F.explode(F.map_from_arrays(F.array(F.lit("AUTHORS"), F.lit("APPROVES")), F.array("a", "b"))).alias("kind", "all"))
    people = people.select(*tag, F.col("kep").alias("at"), "kind", F.explode("all").alias("who"), F.lit(None).cast("string").alias("name"))

    # proposals' texts; those without YAML state owner and authors
    proposals = docs.where("kind = 'kep_readme'").withColumn("m", F.struct(*[c.alias(k) for k, c in D.markdown(F.col("text")).items()]))
    title = F.trim(F.regexp_replace(F.get("m.headings", 0), "^[# ]+", ""))
    proposals = proposals.select(
        *tag, T.numbered(text("payload", "dir_number")).alias("kep"), title.alias("title"), (text("payload", "has_kep_yaml") == "true").alias("has"),
        text("payload", "owning_sig_dir").alias("owner"), F.regexp_replace(F.regexp_extract("m.body", AUTHORS, 1), "[*`]", "").alias("authors"),
    )
    legacy = proposals.where("not has")
    wrote = legacy.select(*tag, F.col("kep").alias("at"), F.lit("AUTHORS").alias("kind"), F.explode(F.split("authors", ",", -1)).alias("who"), F.lit(None).cast("string").alias("name"))

    named = leads.select(*tag, "at", "kind", "who", "name").unionByName(people).unionByName(wrote).where("trim(who) <> ''")
    known = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.col("handle").alias("_handle")).dropDuplicates(["_alias"])
    named = named.join(known, F.lower(F.trim("who")) == F.col("_alias"), "left").withColumn("bare", F.coalesce("_handle", T.handle(F.col("who")))).where("bare <> ''")
    person = F.concat(F.lit("person:"), "bare")

    owned = keps.select(*tag, "kep", "owner").unionByName(legacy.select(*tag, "kep", "owner")).where("owner is not null")
    nodes = [
        node(index, F.col("sig"), "sig", props(slug=F.col("slug"), label=text("entry", "label"), name=text("entry", "name"))),
        node(subs, sub_id, "subproject", props(name=F.col("name"))),
        node(charters, _sig(F.col("slug")), "sig", props(charter_title=text("front", "title"))),
        node(keps, F.col("kep"), "kep", props(title=text("y", "title"), status=text("y", "status"))),
        node(proposals, F.col("kep"), "kep", props(title=F.col("title"))),
        node(owned, _sig(F.col("owner")), "sig"),
        node(named, person, "person", props(name=F.nullif(F.col("name"), F.lit("")))),
    ]
    edges = [
        edge(subs, F.col("sig"), sub_id, F.lit("HAS_SUBPROJECT")),
        edge(owned, _sig(F.col("owner")), F.col("kep"), F.lit("OWNS")),
        edge(named, person, F.col("at"), F.col("kind")),
    ]
    all_of = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(all_of(parts[1:]))
    return all_of(nodes), all_of(edges)
