"""Documents with front matter: its fields, the class of a document, headings, and the template that a question asks for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.functions.questions import template

__all__ = ["claims", "classify", "field", "front_fields", "markdown", "template", "type_of_path", "yaml_json"]

# Document types with the words that a path names them by, in the order in which they are tried.
PATH_WORDS = [
    ("policy", r"(?i)polic(?:y|ies)"),
    ("standard", r"(?i)standards?"),
    ("guideline", r"(?i)guidelines?"),
    ("sop", r"(?i)sops?|procedures?|process(?:es)?"),
    ("jobaid", r"(?i)job[-_]?aids?|quick[-_]?refs?|cheat[-_]?sheets?"),
    ("transcript", r"(?i)transcripts?|meetings?|calls?"),
]
CLASS_NAMES = {"policy": "Policy", "standard": "Standard", "guideline": "Guideline", "sop": "SOP", "jobaid": "JobAid", "transcript": "Transcript"}
NORMATIVE = ["policy", "standard", "guideline"]
# The leading block of simple fields and a field's line.
BLOCK = r"(?s)^---\s*\n(.*?)\n---"
FIELD = r"(?md)^(\w+)\s*:\s*(.+)$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def front_fields(text: Column) -> Column:
    """Array of (k, v) of the simple `key: value` lines of a leading block between `---` lines; keys in lower case."""
    block = F.regexp_extract(text, BLOCK, 1)
    part = lambda i: F.regexp_extract_all(block, F.lit(FIELD), F.lit(i))
    return F.arrays_zip(F.transform(part(1), F.lower).alias("k"), F.transform(part(2), _strip).alias("v"))


def field(fields: Column, *names: str) -> Column:
    """The value of the first of the names that has one; of a repeated key the last value counts."""

    def last(name: str) -> Column:
        return F.nullif(F.try_element_at(F.filter(fields, lambda x: x["k"] == name), F.lit(-1))["v"], F.lit(""))

    return F.coalesce(*[last(n) for n in names])


def type_of_path(path: Column) -> Column:
    """The type that the first telling component of the path names; null if none does."""
    typed = F.lit(None).cast("string")

    def one(part: Column) -> Column:
        found = typed
        for name, words in reversed(PATH_WORDS):
            found = F.when(part.rlike(words), name).otherwise(found)
        return found

    return F.get(F.filter(F.transform(F.split(F.translate(path, "\\", "/"), "/", -1), one), lambda x: x.isNotNull()), 0)


def classify(path: Column, text: Column, base: str = "urn:class:") -> dict[str, Column]:
    """doc_type, class_uri, partition, name, effective_date and scope of a document.

    The front matter's type counts first, in either number; then the path; then `sop`.
    Null paths and texts are taken as empty.
    """
    path, fields = F.coalesce(path, F.lit("")), front_fields(F.coalesce(text, F.lit("")))
    said = F.lower(field(fields, "type"))
    known = list(CLASS_NAMES)
    single = F.when(said.endswith("ies"), F.concat(F.regexp_replace(said, "ies$", ""), F.lit("y"))).otherwise(
        F.when(F.regexp_replace(said, "s$", "").isin(known), F.regexp_replace(said, "s$", "")).otherwise(said)
    )
    kind = F.coalesce(F.when(single.isin(known), single), type_of_path(path), F.lit("sop"))
    names = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"^(\.*[^.].*)\.[^.]*$", "$1")
    return {
        "doc_type": kind,
        "class_uri": F.concat(F.lit(base), F.element_at(names, kind)),
        "partition": F.when(kind.isin(NORMATIVE), "normative").otherwise("descriptive"),
        "name": F.coalesce(field(fields, "title", "name"), stem),
        "effective_date": field(fields, "effective_date", "effectivedate"),
        "scope": field(fields, "scope"),
    }


def markdown(text: Column) -> dict[str, Column]:
    """block (the raw front matter, null without one), body and headings of a Markdown text."""
    bare = F.regexp_replace(text, r"^\s+", "")
    rest = F.when(bare.startswith("---"), F.substr(bare, F.lit(4)))
    end = F.instr(rest, "\n---")
    cut = F.coalesce(end > 0, F.lit(False))
    body = F.when(cut, F.regexp_replace(F.substr(rest, end + 4), "^\n+", "")).otherwise(text)
    lines = F.split(body, r"\r\n|\n|\r", -1)
    return {
        "block": F.when(cut, F.substr(rest, F.lit(1), end - 1)),
        "body": body,
        "headings": F.filter(F.transform(lines, _strip), lambda x: x.startswith("#")),
    }


@F.pandas_udf(T.StringType())
def yaml_json(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """YAML mappings as JSON, read by the safe loader; `{}` for anything else, null for null."""
    import yaml

    def one(block: str | None) -> str | None:
        if block is None:
            return None
        try:
            found = yaml.safe_load(block)
        except yaml.YAMLError:
            found = None
        return json.dumps(found, default=str) if isinstance(found, dict) else "{}"

    for series in blocks:
        yield series.map(one, na_action=None).astype(object)


# What prose says of relations, by the kind of document; no match holds a full stop.
RULES = {
    "sig": [("COLLABORATES_WITH", r"(?i)collaborat\w*\s+(?:closely\s+)?with\s+(SIG[\s-][A-Za-z][\w-]*)")],
    "kep": [
        ("SUPERSEDES", r"(?i)supersedes\b[^.]{0,120}?(KEP-\d+)"),
        ("DEPENDS_ON", r"(?i)(?:depends on|builds on)\b[^.]{0,120}?(KEP-\d+)"),
    ],
}
MOST_CLAIMS = 20


def claims(kind: Column, body: Column, most: int = MOST_CLAIMS) -> Column:
    """Array of (predicate, object, span) that the rules of the document's kind find in its whole body, the first `most`.

    A match lies within one full-stop piece, which is its span; so each piece is searched alone, without a shuffle.
    """
    pieces = F.split(body, r"\.", -1)

    def found(predicate: str, words: str) -> Column:
        of_piece = lambda p: F.transform(
            F.regexp_extract_all(p, F.lit(words), F.lit(1)),
            lambda o: F.struct(F.lit(predicate).alias("predicate"), o.alias("object"), _strip(F.regexp_replace(p, r"\s+", " ")).alias("span")),
        )
        return F.flatten(F.transform(pieces, of_piece))

    empty = F.array().cast("array<struct<predicate:string,object:string,span:string>>")
    out = empty
    for name, rules in RULES.items():
        out = F.when(kind == name, F.concat(*[found(*rule) for rule in rules])).otherwise(out)
    return F.slice(F.coalesce(out, empty), 1, most)
