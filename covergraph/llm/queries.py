"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph.llm import chat, decontaminate, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, warc
from covergraph.llm._common import crc_mod, materialize, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT CAST(conv AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES "
                     f"(-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}') AS t(conv, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.render(chat.fold(chat.conversation_events(rows))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = docs.select("doc_id", language_id.predict(model, docs, F.col("text")).alias("p"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "p.*")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return warc.record_index(warc.read_chunks(manifest, with_data=False)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = materialize(quality_rules.score(docs, quality_rules.fit(docs)).select("doc_id", "lang", "quality"), "quality-scores")
    return quality_rules.verdict(scored, quality_rules.bands(scored)).select(
        "doc_id", *[f"quality.{c}" for c in quality_rules.BASE], "quality.base_failed", "quality.kept", "quality.bits")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = docs.select("doc_id", quality_classifier.statistics(F.col("text")).alias("s")).select("doc_id", model.column(F.col("s")).alias("score"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer, tail = lm_scoring.fit(docs.where(crc_mod("doc_id", 7) != 2))
    scored = lm_scoring.score(docs, scorer, tail)
    return scored.select(
        "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(scorer.n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0), lambda a, x: a + x).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op3_warc": warc.ORACLE, "op6_mixing": mixing.ORACLE, "op8_decontamination": decontaminate.ORACLE}
