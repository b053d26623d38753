"""The registered queries of this subpackage and their SQL.

The queries derive the contract's columns from the operators' own outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.llm import chat, warc
from brinewell.llm.curriculum import curriculum
from brinewell.llm.decontaminate import SLOP, benchmark_matches
from brinewell.llm.html_text import extract
from brinewell.llm.language_id import fit, held_out, identify
from brinewell.llm.licenses import scan_licenses
from brinewell.llm.near_dedup import near_duplicates
from brinewell.llm.pii import KINDS, personal_data, span_list
from brinewell.llm.quality import quality_rules
from brinewell.plans.lineage import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_table(spark, sf_dir, "documents"))
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op3_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum(_table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the items found by proximity, exact matches among them, as more columns."""
    found = benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=SLOP)
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    chats = chat.format_chats(chat.events_from_turns(turns.union(extra)))
    read = chats.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` have no paths: a document lies in source/<doc_id / 100>, and one whose last line says "licen" is its licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.contains(F.lower(F.substring_index("text", "\n", -1)), F.lit("licen")), "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
    return found.select(F.col("id").alias("doc_id"), "license", "cosine", "origin", "license_dir")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_facts(warc.assemble(warc.read_warc(spark, path)))


def queries() -> dict:
    own = (op1_quality_rules, op2_pii, op3_curriculum, op4_decontaminate, op5_chat_format, op6_license_scan, op7_language_id, op8_near_dedup, op9_html_text, op10_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from brinewell.llm.oracles import ORACLES

    return ORACLES
