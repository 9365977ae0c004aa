"""Queries ``opN_<name>`` of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.llm import decontaminate, licenses, mixing, phrases, pii, quality, sharding, simhash, toxicity, warc
from docledger.plans.storage import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), decontaminate.item_rows(table(spark, sf_dir, "benchmark")))


#: The labelled categories in the order of the chain.
CATEGORIES = ["low_quality", "toxic"]


def category_labels(labels):
    """``labels(doc_id, quality, toxic)`` as one 0/1 column for each category."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, category_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.scores(docs, models, CATEGORIES)


def op4_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.digest_rows(table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.verdicts(table(spark, sf_dir, "documents"), good)


def op8_licenses(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op9_phrases(spark, sf_dir):
    return phrases.digest(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_simhash, op2_decontamination, op3_toxicity, op4_pii, op5_mixing, op6_warc, op7_quality, op8_licenses, op9_phrases, op10_sharding)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    return {"op5_mixing": mixing.ORACLE, "op10_sharding": sharding.ORACLE}
