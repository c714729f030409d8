"""A corpus pipeline: quality rules, deduplication, decontamination, tokenisation.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the one before it kept and
returns documents with the same columns; the last one returns the digests of the encoded texts.

Defined results, for every stage: an empty table gives an empty one; a null text counts as empty;
texts are taken whole, however long; other columns than ``doc_id``, ``text`` and ``n_chars`` are
kept as they are, whatever their names. What a stage does with null and repeated ids it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktoire.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from sparktoire.llm.common import materialized, table
from sparktoire.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged row by row: ids, null or repeated, don't matter.

    Null and empty texts have too few words and go.
    """
    return quality.accepted(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id.

    Rows of one id are one document; rows without an id are documents of their own text. Empty and
    null texts are copies of each other. Of rows equal in id and class any one stays.
    """
    return near_dedup.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller id has; ``n_chars`` follows.

    A row without an id comes after all others; rows of one id take nothing from each other. A null
    text becomes an empty one.
    """
    cut = suffix_dedup.cleaned(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows of one id, null too, count as one document and go or stay together; rows of one item's id
    are one item. Null and empty texts hold nothing and stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of every document's ids and of the text decoded from them, row by row.

    Null and empty texts have no tokens; null and repeated ids are kept as they are.
    """
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: SQL can express neither byte-level BPE nor sampled classes; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
