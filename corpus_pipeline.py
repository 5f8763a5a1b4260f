"""A corpus pipeline: quality, line dedup, near copies, repeated passages, packing.

Each stage takes what its predecessor kept, as a written table, and all but the last return the columns of
``documents``. Stages need only the shared folder that the session names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import line_dedup, near_copies, packing, quality, suffix_dedup
from lexmill.llm.common import written


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage makes of ids and texts, with the columns of ``docs`` as they were, whatever names the stage uses."""
    own = [c for c in docs.columns if c in ("doc_id", "text", "n_chars")]
    rest = [c for c in docs.columns if c not in own]
    held = docs.select(*own, *([F.struct(*rest).alias("lexmill_rest")] if rest else []))
    return stage(held).select(*[F.col(c if c in own else f"lexmill_rest.`{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labelled rows that are not held out.

    Null and empty texts get the score of no measure and go or stay alike; rows that repeat a text go or stay together;
    labels with a null id or value are not read; an empty table stays empty; without labels of both kinds all stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, lambda held: quality.scored(held, model).filter("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; each such line stays in the document of the largest id.

    Null texts become empty ones; rows with a null id keep all lines; rows that repeat an id count as one document;
    an empty table stays empty.
    """
    return beside(docs, line_dedup.line_dedup)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity from about 0.8 on), the smallest id.

    Texts without words are one group, null texts among them; rows with a null id stay; rows that repeat an id stay or go
    together; an empty table stays empty.
    """
    return near_copies.keep_one(docs).select(docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once, nor characters that a cut has split.

    Null texts become empty ones; shorter texts stay as they are; rows that repeat a text lose all of it, if it is long
    enough, whatever their ids; an empty table stays empty.
    """
    return beside(docs, suffix_dedup.dedup)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 ids.

    A null or empty text is one piece of the closing id; a null id stays null; an empty table has no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL expresses none of the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
