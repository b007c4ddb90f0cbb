"""A training corpus from raw documents: quality filter, exact and near deduplication, source mix, tokens.

Each stage takes all rows that the one before kept. The first four return the columns of ``documents``; a document that
the mix takes twice is there twice. The last returns ids and digests for each of those rows.

Defined results of every stage: an empty table gives an empty one; texts are taken whole, however long; other columns are
kept by all but the last stage, also those that have names which an operator uses itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from steadfield.llm import bag_minhash, byte_bpe, common, exact_dedup, mixing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more. Null texts are scored as empty ones, repeated rows alike; without labels all stay."""
    return quality.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after folding white space the row with the smallest doc_id; null counts as empty, a null doc_id
    comes last, and of rows that tie one stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, 0.8): that with the smallest doc_id, null first. Texts without
    words, null ones too, are one class; texts of fewer than five words are near their equals only."""
    return bag_minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to twice. A null source is one of its own; documents without words are not taken;
    of repeated rows the first take the odd copies."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of each row, in any order; null texts have no ids."""
    return byte_bpe.with_tokens(docs, ["doc_id", "lang", "source"], public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("byte-level BPE", tokens),
]

#: SQL has no compression, sketching, sampling by flights or BPE; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = common.new_path(spark, "stage-" + name.replace(" ", "-"))
        with common.scratch(spark):  # a stage's own tables go once its result is written
            docs = common.materialize(stage(spark, docs, sf_dir), name, out)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
