"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last
return the columns of ``documents``; rows leave only where a stage rejects them.

Defined results for every stage: a null text counts as an empty one where it is judged and stays null where it is kept; a null
doc_id is a document like any other; repeated rows are judged alike; an empty table gives no rows; further columns pass
through.  What a stage does besides is in its docstring and its operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.llm import bpe, decontaminate, jaccard, pii, quality
from corpusflow.llm.queries import KEY, tokenizer_path
from corpusflow.session import scratch_path, ship_package
from corpusflow.sources.tables import load


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage model doesn't reject.  Empty and null texts are scored as a bag of one empty passage; without labels of both classes
    every document has the same score."""
    ship_package(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id (a null one last), of each group linked by the n-gram Jaccard join; of identical rows, one.
    Empty, null and wordless texts link with nothing and all stay."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.  Texts and items without words have no windows."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal numbers, dates and addresses; n_chars follows the text (null for a null text)."""
    out = pii.pseudonymise(docs, KEY, count="__changed")
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document encoded and decoded; null and empty texts give no token."""
    ship_package(spark)
    return bpe.encoding_digests(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", pseudonymise),
    ("bpe", encode),
]

#: SQL cannot express the trained classifier and the keyed permutations; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; intermediate tables go to the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
