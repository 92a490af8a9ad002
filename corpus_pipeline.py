"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixture.

Each stage is given the rows of the one before reread from where they were written, and so may sweep that one's scratch folders: one
pipeline at a time in a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import common, decontamination, jaccard_join, mixing, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    common.prepare(spark)
    common.SCRATCH.clear()  # an earlier run's results may still be read
    judged = quality_rules.judged(docs)
    return judged.where(judged[judged.columns[-1]]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingles with a similarity of 0.8 or more: that with the smallest doc_id."""
    common.sweep(spark)
    return jaccard_join.representatives(docs, n=5, num=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    common.sweep(spark)
    found = decontamination.scan(docs, common.table(spark, sf_dir, "benchmark"))
    return found.where(~found[found.columns[-2]]).select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced; n_chars follows the new text."""
    common.sweep(spark)
    out = pii.replaced(docs, pii.key_of(spark)).select(*docs.columns)
    return out.withColumn("n_chars", pii.F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the number of copies; the columns of documents come first."""
    common.sweep(spark)
    out = mixing.mixed(docs)
    return out.where(out[out.columns[-2]] > 0)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii_surrogates", surrogates),
    ("source_mixture", mixture),
]

#: Neither the model's verdict nor keyed surrogates can be stated in SQL; tests/llm holds the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's rows are stored, and deleted when the next one's are."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}", swept=False)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
