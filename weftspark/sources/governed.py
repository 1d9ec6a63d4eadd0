"""Governed documents derived from the tables: files with a path, front matter and text at a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.sources.graph import table

#: Folders by document number modulo their number, and the class that each names.
FOLDERS = [("policies", "policy"), ("standards", "standard"), ("guidelines", "guideline"), ("sops", "sop"), ("job-aids", "jobaid"), ("meetings", "transcript"), ("misc", "sop")]
#: Front matter by document number modulo 5.
FRONTS = [
    "",
    "---\ntitle: T {id}\neffective_date: {day}\nscope: {source}\n---\n",
    "---\neffective_date: {day}\nscope: {source}\n---\n",
    "---\ntitle: T {id}\nscope: {source}\n---\n",
    "---\neffective_date: soon\nscope: {source}\n---\n",
]
REPO = "org/handbook"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, sha, text): every third document at its second commit has been edited; one of 31 has an unknown format."""
    key = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(f) for f, _ in FOLDERS]), (key % len(FOLDERS) + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd")

    def front(text: str) -> Column:
        out = F.lit(text)
        for name, value in (("id", key.cast("string")), ("day", day), ("source", F.col("source"))):
            out = F.replace(out, F.lit("{" + name + "}"), value) if "{" + name + "}" in text else out
        return out

    head = F.element_at(F.array(*[front(t) for t in FRONTS]), (key % len(FRONTS) + 1).cast("int"))
    mail = F.when(key % 9 == 2, "\nWrite to a.b@c.org or +44 20 7946 0958.").otherwise("")
    ends = F.when(key % 31 == 7, ".xyz").when(key % 4 == 3, ".pptx").otherwise(".md")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(folder, F.lit("/doc-"), key.cast("string"), ends).alias("path"), F.substring(F.sha2(F.concat("source", F.lit(":"), key.cast("string")), 256), 1, 40).alias("sha"),
        F.concat(head, "text", mail).alias("text"),
    )


def _front_sql() -> str:
    parts = []
    for text in FRONTS:
        out = "'" + text.replace("\n", "' || chr(10) || '") + "'"
        for name, value in (("id", "doc_id::VARCHAR"), ("day", "strftime(DATE '2023-01-01' + (doc_id % 900)::INT, '%Y-%m-%d')"), ("source", "source")):
            if "{" + name + "}" in text:
                out = f"replace({out}, '{{{name}}}', {value})"
        parts.append(out)
    return f"([{', '.join(parts)}])[doc_id % {len(FRONTS)} + 1]"


FILES_SQL = f"""files AS (SELECT doc_id, ([{', '.join(repr(f) for f, _ in FOLDERS)}])[doc_id % {len(FOLDERS)} + 1] || '/doc-' || doc_id || CASE WHEN doc_id % 31 = 7 THEN '.xyz' WHEN doc_id % 4 = 3 THEN '.pptx' ELSE '.md' END AS path,
  left(sha256(source || ':' || doc_id), 40) AS sha, source, {_front_sql()} || text || CASE WHEN doc_id % 9 = 2 THEN chr(10) || 'Write to a.b@c.org or +44 20 7946 0958.' ELSE '' END AS text FROM documents)"""
#: What classification says of the files, from their number alone.
CLASSED_SQL = f"""classed AS (SELECT doc_id, 'urn:doc:' || path AS s, path, sha, source, ([{', '.join(repr(c) for _, c in FOLDERS)}])[doc_id % {len(FOLDERS)} + 1] AS kind,
  CASE WHEN doc_id % 5 IN (1, 3) THEN 'T ' || doc_id ELSE 'doc-' || doc_id END AS name, CASE WHEN doc_id % 5 IN (1, 2) THEN strftime(DATE '2023-01-01' + (doc_id % 900)::INT, '%Y-%m-%d') WHEN doc_id % 5 = 4 THEN 'soon' END AS day,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS scope, CASE WHEN doc_id % 4 = 3 THEN 'markitdown' ELSE 'passthrough' END AS extractor FROM files)"""
