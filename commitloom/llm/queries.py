"""Queries on training texts: source files, names, personal data, leaks, mixtures and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .leakage import leak_report, leaks
from .mixing import mix, shares
from .names import link_names, repository_names, spelling_pairs
from .pii import pii_places, redacted_messages
from .sentences import split_documents
from .syntax import flag_files, parse_rates


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_files(table(spark, d, "blobs")).filter("broken").select("blob_id").distinct()


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Every judged file with its verdict, the language found and the languages that it parses in."""
    return flag_files(table(spark, d, "blobs")).select("blob_id", "language", "detected", "verdict", F.array_join("parses", ",").alias("parses")).distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_rates(flag_files(table(spark, d, "blobs")))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return link_names(*repository_names(table(spark, d, "commits"), table(spark, d, "change_details")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spelling_pairs(_linked(spark, d))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the spelling that stands for its entity."""
    return _linked(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii_places(table(spark, d, "bugs"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message with typed placeholders."""
    return redacted_messages(table(spark, d, "bugs"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked."""
    return leak_report(_leaks(spark, d), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the sources reach."""
    targets = table(spark, d, "mix_targets")
    return shares(mix(table(spark, d, "documents"), targets), targets)


def p8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with unequal inclusion: long documents count less."""
    documents = table(spark, d, "documents").withColumn("weight", 1 / F.log(F.col("n_chars") + F.lit(3)))
    return mix(documents, table(spark, d, "mix_targets"), weight_col="weight")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


def p9_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and their mean length by source."""
    found = split_documents(table(spark, d, "documents"))
    sources = table(spark, d, "documents").select("doc_id", "source")
    per_doc = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return per_doc.join(sources, "doc_id").groupBy("source").agg(F.sum("n").alias("sentences"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars"))


QUERIES = {f.__name__: f for f in (p3_found, p3_files, p3_rates, p5_found, p5_entities, p6_found, p6_redacted, p7_found, p7_items, p8_mixture, p8_shares, p8_weighted, p9_found, p9_per_source)}

ORACLE: dict[str, str] = {}
