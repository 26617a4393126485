"""A corpus from documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm import packing, rules, similar, simhash, toxicity
from cloudweave.llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the toxicity field rejects; it is fitted on labelled rows of docs itself."""
    return toxicity.clean(docs, toxicity.fit_table(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged with their hosts; rows go along as structs, so no column clashes."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "source")
    return rules.judged(rows, drop=("text",)).where("kept").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at a similarity of 0.8 on five-word shingles."""
    return similar.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", clean), ("quality rules", good), ("near-dedup", distinct), ("packing", packed)]
#: The same with near-duplicates by five-word similarity instead of op4's contract.
NEAR_STAGES = [(name, dissimilar if stage is distinct else stage) for name, stage in STAGES]

#: The field of the first stage is fitted, so SQL can't express it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k < len(stages) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs


def run_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As run, with near-duplicates by five-word similarity."""
    return run(spark, sf_dir, NEAR_STAGES)
