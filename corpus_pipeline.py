"""From raw documents to token ids: five stages, each of one operator, each on all that the one before kept.

What holds for all stages: rows of any order and number come in, none included, and columns beyond doc_id, text, lang and
source stay as they are whatever their names, in all stages but the last; n_chars, where there is such a column, follows the
text. Null texts count as empty. Rows with the same id and other texts are documents of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotoba.llm import bpe, jaccard, line_dedup, mixing, quality
from kotoba.llm.runtime import clean, fresh, table, tables_written, written


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that lose too much with them or fail the base: null and empty texts do,
    repeated rows share their fate."""
    return _sized(quality.clean_documents(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left by that. The first place is that
    of the smallest id (null before all), then of the smaller hash of the text; repeated rows are one place and all stay
    or change alike; null and empty texts stay."""
    (removed,) = fresh(docs, "removed")
    out = line_dedup.dedup_lines(docs, removed=removed).where(~((F.size(removed) > 0) & (F.trim(F.col("text"), F.lit(line_dedup.BLANK)) == "")))
    return _sized(out.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays: that of the smallest id (null after all), ties by the hash of the
    text; of repeated rows one stays. Null, empty and blank texts are similar to nothing and stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the calibrated probabilities: by their ids, so rows of one id and cell share their fate. Null
    sources and languages are cells of their own; texts without tokens have the probability of their cell."""
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to; no ids for null and empty texts."""
    encoded = bpe.encode_documents(docs, *bpe.tokenizer())
    return encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the encoding of the last stage; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean(since, but=1)  # what led to these rows
    return STAGES[-1][1](spark, docs, sf_dir)
