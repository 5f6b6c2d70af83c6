"""From raw documents to packed training sequences: five stages, each one operator over all its input.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read back as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from folioflow.llm.common import stage
from folioflow.llm.queries import WORD_TOKENIZER, repository, tokenizer_path
from folioflow.plans import staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage of each thread staged for itself: pipelines in several threads leave each other's tables alone.
_left = threading.local()


def _frees(function: Stage) -> Stage:
    """What a stage staged for itself goes when the next stage begins: its result has been written by then.

    Tables that the next stage's input still reads stay.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = getattr(_left, "paths", [])
        if left:
            read = docs.inputFiles()
            for path in [p for p in left if not any(p.split(":", 1)[-1].lstrip("/") in f for f in read)]:
                staging.delete(spark, path)
        before = len(staging.made())
        out = function(spark, docs, sf_dir)
        _left.paths = staging.made()[before:]
        return out

    return run


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.apply_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts become a placeholder."""
    return secret_scan.redact_secrets(docs, F.col("source"), repository())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = packing.pack_documents(docs, tokenizer_path(WORD_TOKENIZER))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", _frees(drop_low_quality)),
    ("n-gram Jaccard join", _frees(drop_near_copies)),
    ("secret scan", _frees(redact_secrets)),
    ("source mixing", _frees(mix_sources)),
    ("packing", _frees(pack_sequences)),
]

#: Trees, MinHash and tokenizers are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
