"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import (
    chat, decontaminate, exact_dedup, html_text, infill, language, line_dedup, mixing, near_dedup, neighbours, periodic, secrets, toxicity,
)
from weftspark.llm.common import WORD, new_folder, table, word_count


def fold(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def quality_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, weight): 2 for documents labelled good, 1/2 for those labelled bad."""
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.select(F.col("doc_id").alias("label_id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weighted = sized.join(quality_weight(spark, sf_dir), F.col("doc_id") == F.col("label_id"), "left")
    return mixing.mix_sources(weighted, F.col("size"), F.col("weight"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"), sf_dir).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.digest_chats(chat.format_chats(rows))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where((fold(5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    return toxicity.train(docs, labels, "doc_id", "text", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.score(toxic_model(spark, docs, sf_dir))
    return docs.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo")
    )
    return secrets.digest_secrets(secrets.scan_secrets(docs, repo_col="repo"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold(4) != 2), "doc_id", "text", "lang")
    found = language.predict(docs, model, "text", ["doc_id"])
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), new_folder(spark, "digests"))


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of docs, by crc32 of the id, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = docs.select("doc_id", F.col("text").alias("_text"), F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.floor(h / 10)).alias("_g"))
    words = hit.withColumn("_words", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("_text", F.lit(WORD), 0)))
    n = F.size("_words")
    placed = words.withColumn("_a", (F.col("_g") % n).cast("int"))
    room = n - F.col("_a")
    placed = placed.withColumn("_p", (F.floor(room / (3 + F.col("_g") % 8)) + 1).cast("int"))
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(room / F.col("_p")).cast("int"))), F.lit(1), room)
    return placed.select(
        "doc_id", F.when(F.col("_g").isNull(), F.col("_text")).otherwise(F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")).alias("text")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("_top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.q")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.q")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_line_dedup, op3_near_duplicates, op4_chat_format, op5_toxicity, op6_secrets, op7_decontaminate,
        op8_html_text, op9_nearest, op10_language, op11_exact_dedup, op12_periodic_runs, op13_fill_in_middle,
    )
}

ORACLES = {"op1_mix_sources": mixing.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op4_chat_format": chat.ORACLE, "op11_exact_dedup": exact_dedup.ORACLE, "op13_fill_in_middle": infill.ORACLE}
