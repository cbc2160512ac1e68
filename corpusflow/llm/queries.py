"""Registered queries of the subpackage: whole tables in, the operators' full results out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.llm import alignment, bpe, chat, decontaminate, fingerprint, jaccard, language, learning, licenses, neighbours, pii, quality, repair, toxicity
from corpusflow.sources.tables import load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file: $CORPUSFLOW_TOKENIZERS, or the installed package of such files."""
    folder = os.environ.get("CORPUSFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


#: Key of the registered queries' pseudonyms; a user passes a secret one.
KEY = "corpusflow"


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with pseudonyms in place of validated numbers, dates and addresses."""
    return pii.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every whole document."""
    return licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold control strings."""
    fixed = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.conversation_digests(chat.format_conversations(rows))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.similarity_classes(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key", "root")


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id is divisible by 20."""
    return neighbours.nearest(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    return bpe.encoding_digests(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def _scored(spark: SparkSession, sf_dir: str, operator, cut: float) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = operator.train(docs, load(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), "text")
    return operator.score(rows, model, cut=cut, keep=("doc_id", "held_out"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every whole text, learned from the documents that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    rows = docs.select("doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.predict(rows, model, keep=("doc_id", "held_out"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by the factorization machine."""
    return _scored(spark, sf_dir, toxicity, 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by the passage model."""
    return _scored(spark, sf_dir, quality, 0.3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item in every whole document."""
    found = decontaminate.contamination(load(spark, sf_dir, "documents").select("doc_id", "text"),
                                        load(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.drop("th")


def op11_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's fingerprint beside those of its edited text and of the next document."""
    return fingerprint.edited_likeness(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's tokens under two tokenizers, aligned by bytes, with corpus-wide counts of linked ids."""
    return alignment.alignment_digests(load(spark, sf_dir, "documents").select("doc_id", "text"),
                                       tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults and the cheapest repair."""
    return repair.repair_digests(repair.damage(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {
    "op1_pii_feistel": op1_pii_feistel,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_bpe": op6_bpe,
    "op7_language_mixture": op7_language_mixture,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_piecewise_fingerprints": op11_piecewise_fingerprints,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}
