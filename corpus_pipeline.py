"""A training corpus from raw documents: STAGES in order, each reading what the one before it kept.

For all stages: null text counts as empty; rows with a null id are kept by the dedup stages and judged by their text by the models; a
very long text takes memory in proportion to its length; repeated rows are one document to the dedup stages; an empty table gives no rows; columns other
than doc_id, text and lang are handed on as they are, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import Workspace, documents
from corvane.llm.exact_dedup import keep_first
from corvane.llm.minhash import one_of_each
from corvane.llm.packing import pack_documents
from corvane.llm.quality import accepted_only
from corvane.llm.toxicity import without_toxic
from corvane.session import ship

#: Encoded words that a worker remembers: it shares its executor's memory with all stages, and keeps them.
REMEMBERED = 100_000


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model doesn't reject as toxic. An empty text has the model's bias as its score."""
    return without_toxic(docs, labels(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity and variety are within their language's limits. Empty texts stay; a null language has the limits of all."""
    return accepted_only(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with most characters, then the smallest id. All empty texts are one group."""
    ship(spark)
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8; the one with the smallest id. Empty texts are near nothing."""
    ship(spark)
    return one_of_each(docs, Fraction(4, 5))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens; an empty text is its end token."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, remembered=REMEMBERED)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the trained stages or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder before the next reads it."""
    docs, ws = documents(spark, sf_dir), Workspace(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
