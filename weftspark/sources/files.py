"""Files read as tables: quads as lines of N-Quads, and the listing of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IRI, _NODE = r"<([^<>\s]*)>", r"(?:<([^<>\s]*)>|(_:[^\s]+))"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z0-9-]+))?'


def quads(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """(g, s, p, o, o_kind, o_type, o_lang) of files of N-Quads or N-Triples; a graph given names the partition of all.

    Comments and blank lines go; a line that is none of these is an error. A graph's URI holds no > and no white space.
    """
    if graph is not None and (not graph or ">" in graph or any(c.isspace() for c in graph)):
        raise ValueError(f"no graph URI: {graph!r}")
    line = rf"^\s*{_NODE}\s+{_IRI}\s+(?:{_NODE}|{_LITERAL})\s*(?:{_IRI})?\s*\.\s*$"
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    broken = F.raise_error(F.concat(F.lit("no quad: "), F.col("value"))).cast("string")
    s = F.when(~F.col("value").rlike(line), broken).otherwise(F.coalesce(part(1), part(2)))
    iri = F.coalesce(part(4), part(5))
    text = F.regexp_extract("value", line, 6)
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.select(
        (F.lit(graph) if graph is not None else F.coalesce(part(9), F.lit("default"))).alias("g"), s.alias("s"), part(3).alias("p"), F.coalesce(iri, text).alias("o"),
        F.when(iri.isNotNull(), "iri").otherwise("literal").alias("o_kind"), F.when(iri.isNull(), F.coalesce(part(7), F.lit("string"))).alias("o_type"), part(8).alias("o_lang"),
    )


def listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(path, content) of the files under root/prefix, paths relative to root; a path that leaves its folder is refused."""
    if any(part == ".." for part in prefix.split("/")):
        raise ValueError(f"{prefix} leaves its folder")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{prefix}")
    bare = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/+", "/")
    path = F.substr("path", F.instr("path", bare) + F.length(bare) + 1)
    return found.select(path.alias("path"), "content").where(~F.array_contains(F.split("path", "/"), ".."))
