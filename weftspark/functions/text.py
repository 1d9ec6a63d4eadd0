"""Identity rules, cleansing, chunking and question cues as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The detectors, header rules, control characters and bounds whose results are compared.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?1?[\s\-.]?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}|\+44\s?\d{2,4}\s?\d{3,4}\s?\d{3,4}|\+\d{1,3}[\s\-]?\d{6,14})"
SSN = r"\b\d{3}[\-\s]\d{2}[\-\s]\d{4}\b"
CARD = r"(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))[\s\-]?(?:[0-9]{4}[\s\-]?){2,3}[0-9]{1,4}"
UK_NI = r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[ABCD]\b"
AU_TFN = r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}\b"
DETECTORS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "credit_card": CARD, "uk_ni": UK_NI, "au_tfn": AU_TFN}
HEADER = r"(?i)^(?:Page\s+\d+\s+of\s+\d+$|Page\s+\d+$|\d+\s*$|-+\s*\d+\s*-+$|Confidential\b|Proprietary\b|Internal\s+Use\s+Only\b)"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADING = r"(?m)^#{1,6}\s+"
PARAGRAPH = r"\S[^\n]{10,}\S"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}]"
CONTROL_SHARE = 0.15
LEAST_CHARS = 200
#: White space of any kind.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def handle(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(text), "^@+", "")))


def numbered(text: Column) -> Column:
    """kep-<n>: an own prefix goes, a number loses leading zeros."""
    bare = F.regexp_replace(F.trim(text), "(?i)^kep-", "")
    return F.concat(F.lit("kep-"), F.when(bare.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(bare))


def sig_id(text: Column) -> Column:
    """sig:<slug>, the slug with one leading `sig-`."""
    bare = slug(text)
    return F.concat(F.lit("sig:"), F.when(bare.startswith("sig-"), bare).otherwise(F.concat(F.lit("sig-"), bare)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(BLANK))


def pii_counts(text: Column) -> dict[str, Column]:
    """n_<kind> of each detector; kinds may overlap. A text without an @ or a digit is not searched for what needs one."""
    counted = lambda kind, pattern: F.when(text.contains("@") if kind == "email" else text.rlike("[0-9]"), F.regexp_count(text, F.lit(pattern))).when(text.isNotNull(), 0)
    return {f"n_{k}": counted(k, p).cast("long") for k, p in DETECTORS.items()}


def lines(text: Column) -> Column:
    """The lines of a text; the end of a last line begins no further one."""
    found = F.split(text, LINE_END, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def is_header(line: Column) -> Column:
    return stripped(line).rlike(HEADER)


def without_headers(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~is_header(x)), "\n")


def headers(text: Column) -> Column:
    """How many lines `without_headers` drops."""
    return F.size(F.filter(lines(text), is_header)).cast("long")


def has_residue(text: Column) -> Column:
    """Whether a text is binary residue by its share of control characters."""
    return F.regexp_count(text, F.lit(CONTROL)) / F.greatest(F.length(text), F.lit(1)) >= CONTROL_SHARE


def without_residue(text: Column) -> Column:
    return F.when(has_residue(text), F.regexp_replace(text, CONTROL, "")).otherwise(text)


def gate(text: Column) -> Column:
    """The first failing gate of a cleansed text, null if it passes."""
    size = F.length(stripped(text))
    return F.when(size < LEAST_CHARS, F.concat(F.lit("min_content (observed: "), size.cast("string"), F.lit(" chars)"))).when(
        ~text.rlike(HEADING) & ~text.rlike(PARAGRAPH), F.lit("structure")
    )


def cleansed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with clean_text and the report of each: sizes, gates passed and failed, what was stripped, personal data.

    Headers go first, then binary residue, then the gates in order; only a text that passes
    them is looked at for personal data, which never fails it. Null texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_lines", lines(text)).withColumn("_bare", F.filter("_lines", lambda x: ~is_header(x)))
    step = step.withColumn("_plain", F.array_join("_bare", "\n")).withColumn("clean_text", without_residue(F.col("_plain")))
    step = step.withColumn("gate_failed", gate(F.col("clean_text")))
    found = F.when(F.col("gate_failed").isNull(), sum(pii_counts(F.col("clean_text")).values())).otherwise(0).cast("long")
    passed = F.when(F.col("gate_failed").isNull(), "min_content,structure").when(F.col("gate_failed") == "structure", "min_content").otherwise("")
    return step.select(
        *docs.columns, "clean_text", F.length(text).cast("long").alias("chars_raw"), F.length("clean_text").cast("long").alias("chars_clean"), (F.size("_lines") - F.size("_bare")).cast("long").alias("headers_stripped"),
        has_residue(F.col("_plain")).cast("long").alias("binary_stripped"), passed.alias("gates_passed"), "gate_failed", F.col("gate_failed").isNotNull().alias("quarantined"),
        found.alias("pii_entities"), (found > 0).alias("pii_flagged"),
    )


def sections(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(*keys, section, heading, text): the parts of each text between heading lines, whose text is kept as the heading; blank ones left out."""
    lead = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    is_heading = lambda x: lead(x).startswith("#")
    ends = lambda ls: F.filter(F.sequence(F.lit(1), F.size(ls) + 1), lambda i: (i > F.size(ls)) | is_heading(F.try_element_at(ls, i)))
    part = lambda ls, begin, end: stripped(F.array_join(F.slice(ls, begin, F.greatest(end - begin, F.lit(0))), "\n"))

    def cut(ls: Column) -> Column:
        def one(e: Column) -> Column:
            before = lambda i: F.when(i > 0, F.element_at(e, F.greatest(i, F.lit(1)))).otherwise(0)
            heading = lambda i: F.when(i > 0, stripped(F.regexp_replace(stripped(F.element_at(ls, F.greatest(before(i), F.lit(1)))), "^#+", ""))).otherwise("")
            found = F.transform(e, lambda end, i: F.struct(i.alias("section"), heading(i).alias("heading"), part(ls, before(i) + 1, end).alias("text")))
            return F.filter(found, lambda x: x["text"] != "")

        return F.element_at(F.transform(F.array(ends(ls)), one), 1)

    body = F.element_at(F.transform(F.array(lines(F.coalesce(F.col(text_col), F.lit("")))), cut), 1)
    return docs.select(*keys, F.inline(body))


def section_chunks(docs: DataFrame, keys: list[str], text_col: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """(*keys, ordinal, heading, text): windows over the sections of each text; blank windows take no ordinal."""
    parts = sections(docs, keys, text_col)
    starts = F.when(F.length("text") <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("text"), F.lit(size - overlap)))
    pieces = F.transform(starts, lambda i: stripped(F.substr(F.col("text"), i, F.lit(size))))
    cut = parts.select(*keys, "section", "heading", F.posexplode(pieces).alias("window", "piece")).where("piece <> ''")
    order = Window.partitionBy(*keys).orderBy("section", "window")
    return cut.select(*keys, (F.row_number().over(order) - 1).alias("ordinal"), "heading", F.col("piece").alias("text"))


def windows(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(doc_id, ordinal, text): sliding windows over each whole text; blank pieces use no ordinal."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size - overlap))
    pieces = F.filter(F.transform(starts, lambda i: F.substr(F.col("text"), i, F.lit(size))), lambda x: F.btrim(x, F.lit(" \t\n\r")) != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("ordinal", "text"))


def sentences(docs: DataFrame, size: int = 2048, carry: int = 256) -> DataFrame:
    """(doc_id, ordinal, text): sentences filled greedily to `size` characters, the last ones of up to `carry` repeated.

    Sentence lengths count without the spaces between them; an over-long sentence stands alone.
    """
    part = F.array().cast("array<string>")
    empty = F.struct(part.alias("done"), part.alias("open"), F.lit(0).alias("chars"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x)
        full = (F.size(acc["open"]) > 0) & (acc["chars"] + n > size)
        start = F.struct(part.alias("kept"), F.lit(0).alias("chars"), F.lit(True).alias("going"))

        def back(a: Column, y: Column) -> Column:
            fits = a["going"] & (a["chars"] + F.length(y) <= carry)
            return F.struct(
                F.when(fits, F.concat(F.array(y), a["kept"])).otherwise(a["kept"]).alias("kept"), (a["chars"] + F.when(fits, F.length(y)).otherwise(0)).alias("chars"), fits.alias("going")
            )

        tail = F.aggregate(F.reverse(acc["open"]), start, back)
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], " "))).alias("done"), F.concat(tail["kept"], F.array(x)).alias("open"), (tail["chars"] + n).alias("chars")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["chars"] + n).alias("chars")))

    parts = F.filter(F.split("text", r"(?<=[.!?])\s+", -1), lambda x: stripped(x) != "")
    filled = F.aggregate(parts, empty, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"]))
    return docs.select("doc_id", F.posexplode(filled).alias("ordinal", "text"))


def has_cue(text: Column, cues: list[str]) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(lower, F.lit(cue))
    return found


# The words and forms that the screening of graph queries goes by.
FORBIDDEN = r"(?iU)\b(create|merge|set|delete|remove|detach|drop|call)\b"
BRACKET = r"\[[^\]]*\*[^\]]*\]"
ROW_LIMIT = r"(?iU)\bLIMIT\s+(\d+)\b"


def unbounded_path(query: Column) -> Column:
    """Whether a relation of variable length has no upper bound: `*`, `*..` or `*2..` in its bracket."""
    count = lambda b: F.replace(F.regexp_extract(b, r"^[^*]*\*([0-9. ]*)", 1), F.lit(" "), F.lit(""))
    return F.exists(F.regexp_extract_all(query, F.lit(BRACKET), F.lit(0)), lambda b: (count(b) == "") | count(b).endswith(".."))


def limited(query: Column, most: int = 100) -> Column:
    """A query with a row limit of at most `most`: its first limit lowered, or one put behind it; closing semicolons go."""
    bare = F.rtrim(F.rtrim(query, F.lit(BLANK)), F.lit(";"))
    bare = F.rtrim(bare, F.lit(BLANK))
    digits = F.regexp_replace(F.regexp_extract(bare, ROW_LIMIT, 1), "^0+", "")
    over = (F.length(digits) > len(str(most))) | (F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0)) > most)
    return (
        F.when(~bare.rlike(ROW_LIMIT), F.concat(bare, F.lit(f" LIMIT {most}")))
        .when(over, F.regexp_replace(bare, r"(?isU)^(.*?\bLIMIT\s+)\d+\b(.*)$", f"$1{most}$2"))
        .otherwise(bare)
    )


def screened(query: Column, most: int = 100) -> Column:
    """The verdict on a logged graph query: the first rule it breaks, or its text with a row limit of at most `most`.

    Rules look at the bare text, so a forbidden word in a string literal breaks one. A closing semicolon is none.
    """
    bare = stripped(query)
    said = F.filter(F.split(bare, ";", -1), lambda x: stripped(x) != "")
    return (
        F.when(bare == "", "empty")
        .when(F.size(said) != 1, "multiple_statements")
        .when(bare.rlike(FORBIDDEN), "forbidden_clause")
        .when(F.regexp_count(bare, F.lit(r"(?iU)\breturn\b")) != 1, "one_return")
        .when(unbounded_path(bare), "unbounded_path")
        .otherwise(limited(bare, most))
    )


def screened_sparql(query: Column) -> Column:
    """The first rule that a logged triple query breaks, `ok` if none."""
    return (
        F.when(query.rlike(r"(?i)\b(insert|delete|load|clear|create|drop|copy|move|add)\b"), "mutation")
        .when(query.rlike(r"(?i)\bservice\b"), "service")
        .when(~query.rlike(r"(?i)\bselect\b"), "not_select")
        .when(~query.rlike(r"(?i)\bfrom\s+named\b"), "no_from_named")
        .when(query.rlike(r"[A-Za-z>)][*+](\s|$)"), "unbounded_path")
        .otherwise("ok")
    )
