"""Queries of the llm problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import leakage, linkage, mixture, sentences, survivor
from pricewright.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "dealer_listings"), table(spark, d, "hager_products")).select("listing_id", "sku")


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "dealer_listings"), table(spark, d, "hager_products"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_verdicts(spark, d).select("export_id", "verdict")


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts beside the number of fields a row shares with the consensus."""
    return survivor.verdicts(table(spark, d, "sample_products_export"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "sample_products_export"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p9_sized(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture of as many tokens as the corpus has, more than the
    targets allow under the repeat limits: the exponent is bisected to these."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"), size="corpus")[1]


def p9_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture whose exponent is bisected to an entropy of 1.85 nats."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"), target_entropy=1.85)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_confidence, p5_found, p5_verdicts, p5_survivors, p8_found, p9_mixture, p9_shares, p9_sized, p9_entropy, p10_found)}
