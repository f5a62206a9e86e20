"""From raw documents to a training mix: stages that drop, mend and weigh documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.llm import decontaminate, language, mixing, ngram_join, secrets
from fieldseq.llm.base import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents no language model explains; give those without a language the one found.

    Without any labelled text that has letters, only documents without letters go.
    """
    model = language.fit(language.sample_texts(docs))
    if not model.languages:
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    found = language.identify(docs, model).filter("not lang_rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once if its row
    repeats; texts without words, and null ones, have no copies and all stay."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts stay, repeated rows alike."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of secrets; documents stay, with their new length."""
    mended = secrets.redact(secrets.scan(docs))
    size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return mended.withColumn("n_chars", size).select(*docs.columns)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with their number of copies."""
    return mixing.mixed_documents(docs)


STAGES = [("language", known_language), ("near_copies", one_of_near_copies),
          ("benchmark", without_benchmark), ("secrets", without_secrets), ("mix", weighted_mix)]

#: Models and random rounding have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
