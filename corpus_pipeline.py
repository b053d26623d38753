"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Rows are told apart by id and text; rows that agree in both are one document
from the near-duplicate stage on. The SQL of the whole is None: language
identification is a trained network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.llm.curriculum import training_order
from brinewell.llm.decontaminate import SLOP, benchmark_matches
from brinewell.llm.language_id import UNDETERMINED, fit, identify
from brinewell.llm.near_dedup import near_duplicates, row_keys
from brinewell.llm.pii import mask, personal_data
from brinewell.plans.lineage import cut_alone, new_path, scratch, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How far from chance (one over the number of languages) to certainty a document's pooled probability must be.
MIN_LIFT = 1 / 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the model is sure of, go.

    Null and empty texts have no letter and go. Without a labelled document
    there is no model, and all documents with a letter stay. Repeated rows are
    each judged; no documents give no documents. Null ids, labels and sources
    stay as they are, and columns beside those of ``documents`` are not read.
    """
    model = fit(docs)
    read = identify(docs, model, keep=COLUMNS)
    if model is None:
        return read.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    chance = 1 / len(model.languages)
    return read.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= chance + MIN_LIFT * (1 - chance) - 1e-6)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays.

    Documents are rows of different id or text: rows that agree in both are one
    document, and different texts under one id, or without an id, are different
    ones, linked by their words alone. Null and wordless texts are linked with
    nothing and stay. No documents give no documents; columns beside those of
    ``documents`` are not read.
    """
    keyed = docs.select(*COLUMNS, *row_keys(F.col("doc_id"), F.col("text")))
    stay = cut_alone(spark, lambda: near_duplicates(docs, by_id=False).where("first").select("key_a", "key_b"), "stay")
    return keyed.join(stay, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go, and those with the rarest words of one close together.

    Null and empty texts have no words and stay; an empty benchmark matches
    nothing. Rows of equal text share their fate, whatever their ids, null ones
    too. No documents give no documents; columns beside those of ``documents``
    are not read.
    """
    hashes = row_keys(F.lit(None), F.col("text"))[1].alias("key")

    def matched() -> DataFrame:
        found = benchmark_matches(docs.select(hashes, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", slop=SLOP)
        return found.where((F.size("hits") > 0) | (F.size("near_items") > 0)).select(F.col("id").alias("key")).distinct()

    gone = cut_alone(spark, matched, "contaminated")
    return docs.select(*COLUMNS, hashes).join(small(gone), "key", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, and ``n_chars`` of a changed text is its new length.

    Null and empty texts stay as they are. Every row stays; rows of equal text
    are changed alike, whatever their ids, null ones too. No documents give no
    documents; columns beside those of ``documents`` are not read.
    """
    hashes = row_keys(F.lit(None), F.col("text"))[1].alias("key")

    def found() -> DataFrame:
        some = personal_data(docs.select(hashes, "text"), "key").where(F.size("spans") > 0)
        places = some.select(F.col("id").alias("key"), F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("spans"))
        return places.groupBy("key").agg(F.min("spans").alias("spans"))

    spans = cut_alone(spark, found, "spans")
    masked = docs.select(*COLUMNS, hashes).join(small(spans), "key", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col("spans"))))
    return masked.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position; with ``copy`` and ``position``.

    Rows of different id or text are told apart; those that agree in both, and
    in their source, are taken once each, as they stand. Null and empty texts
    have no words. A null source is one of its own. No documents give none;
    columns beside those of ``documents`` are not read.
    """
    return training_order(docs.select(*COLUMNS))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mix", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
