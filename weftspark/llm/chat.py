"""Chat formatting with a loss mask, in column expressions alone.

Format of a conversation: for each block, a run of adjacent turns of one role,
``<|start|>role<|say|>text<|and|>text<|end|>\\n``. Inside roles and texts a backslash
is doubled, and every control string gets a backslash after its first character, so
no text can open or close a turn and the format can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SAY, AND, END = "<|start|>", "<|say|>", "<|and|>", "<|end|>\n"
#: Openings of the control strings that are escaped: this template's own and those of common chat templates.
CONTROL = r"<\||</?s>|<</?SYS|\[/?INST\]"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?={CONTROL})([<\[])", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """(id_col, formatted, loss_runs), one row a conversation.

    Rows are sorted by turn (ties by role, then text; repeated rows stay), and adjacent
    turns of one role make a block. Null roles and texts are empty strings, a null id is
    one conversation. loss_runs tells for consecutive runs of code points of `formatted`,
    which they cover in order, whether they bear loss: the texts of loss_role do,
    separators and headers don't; `last` is true where a block ends. Texts of any length
    are whole. Other columns, whatever their names, are not read. An empty table gives an
    empty result. A conversation is one value of the result, so one task holds it whole.
    """
    rows = turns.select(
        F.col(id_col).alias("_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    talk = rows.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role_at = lambda i: F.element_at(F.col("t"), i)["role"]
    opens = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (role_at(F.greatest(i - 1, F.lit(1))) != role_at(i)))
    talk = talk.withColumn("at", opens)
    until = lambda k: F.coalesce(F.try_element_at(F.col("at"), k + 2), F.size("t") + 1)
    blocks = F.transform(
        "at",
        lambda o, k: F.struct(
            F.concat(F.lit(START), escape(role_at(o)), F.lit(SAY)).alias("head"),
            F.transform(F.slice("t", o, until(k) - o), lambda x: escape(x["text"])).alias("bodies"),
            (role_at(o) == loss_role).alias("loss"),
        ),
    )
    talk = talk.select("_id", blocks.alias("b"))
    no = F.lit(False)
    run = lambda chars, loss, last=no: F.struct(chars.alias("chars"), loss.alias("loss"), last.alias("last"))
    runs = F.flatten(
        F.transform(
            "b",
            lambda x: F.concat(
                F.flatten(
                    F.transform(
                        x["bodies"],
                        lambda y, i: F.array(run(F.when(i == 0, F.length(x["head"])).otherwise(len(AND)), no), run(F.length(y), x["loss"])),
                    )
                ),
                F.array(run(F.lit(len(END)), no, F.lit(True))),
            ),
        )
    )
    formatted = F.array_join(F.transform("b", lambda x: F.concat(x["head"], F.array_join(x["bodies"], AND), F.lit(END))), "")
    return talk.select(F.col("_id").alias(id_col), formatted.alias("formatted"), runs.alias("loss_runs"))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in text)


def _blocks(formatted: Column) -> Column:
    """The blocks of a formatted conversation, each without its end."""
    return F.filter(F.split(formatted, _literal(END), -1), lambda b: b != "")


def loss_texts(formatted: Column, loss_runs: Column) -> Column:
    """What of a formatted conversation its mask marks, run by run, unescaped."""

    def of_block(block: Column, runs: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            cut = F.array(unescape(F.substr(block, acc["at"], x["chars"])))
            return F.struct((acc["at"] + x["chars"]).alias("at"), F.when(x["loss"], F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(runs, start, step, lambda acc: acc["out"])

    ends = F.filter(F.sequence(F.lit(1), F.size(loss_runs)), lambda i: F.element_at(loss_runs, i)["last"])
    after = lambda e, k: F.when(k > 0, F.element_at(e, F.greatest(k, F.lit(1)))).otherwise(0)
    own = lambda e: F.transform(e, lambda end, k: F.slice(loss_runs, after(e, k) + 1, end - after(e, k)))
    by_block = F.element_at(F.transform(F.array(ends), own), 1)
    return F.flatten(F.zip_with(_blocks(formatted), by_block, lambda b, r: of_block(F.concat(b, F.lit(END)), r)))


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    role = lambda b: F.substring_index(F.substr(b, F.lit(len(START) + 1)), SAY, 1)
    said = lambda b: F.substr(b, F.instr(b, SAY) + len(SAY))
    return F.flatten(
        F.transform(
            _blocks(formatted),
            lambda b: F.transform(
                F.split(said(b), _literal(AND), -1),
                lambda x: F.struct(unescape(role(b)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def digest_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what formatted conversations say, read back from their text, and of what their mask marks."""
    back = chats.select(
        F.col(id_col), "formatted", read_chats(F.col("formatted")).alias("t"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_runs")), "").alias("loss")
    )
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|<</?SYS|\[/?INST\]')) AS chars,
         length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|<</?SYS|\[/?INST\]')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN n = 1 OR before <> role THEN 24 + role_chars ELSE 7 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
"""
