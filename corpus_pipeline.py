"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of documents; what a stage rejects, cuts
or leaves out is gone for the next one.

Defined results, for each stage: an empty table gives an empty result; texts are read whole; repeated rows are judged
alike; other columns, of any names, are kept as they are, but by packing.  Null and empty texts fail the quality rules;
they stay in line dedup, the Jaccard join (linked with nothing) and mixing (by the rate of the prior), and packing gives
each the end id.  Rows without doc_id stay, but the Jaccard join links them with nothing.  Ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from verdigris.llm.tables import cut, table

#: Target shares of tokens after the quality rules; the total uses up the clean ones, and a little.
TARGETS = {"clean": 0.95, "low": 0.0, "toxic": 0.05}
SLACK = 1.05


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    ratio = quality_rules.fit(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules.keep(docs, ratio)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 stays."""
    return jaccard_join.without_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the target shares; none is repeated."""
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, SLACK)
    return mixing.draw(docs, rated)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier training and tokenising have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
