"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage is `(spark, docs, sf_dir) -> DataFrame`; all but the last return the columns of documents.

1. quality rules: documents that the base rules or a risk-controlled cutoff reject go
2. line dedup: later occurrences of three-line windows go, and documents that lose all their lines
3. SimHash near-dedup: of each component the document with the smallest id stays
4. benchmark decontamination: documents over the coverage limit go
5. SentencePiece: ids of every document, with the digests and the round-trip flag
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gapline.llm import decontaminate, line_dedup, quality, sentencepiece_bridge, simhash
from gapline.llm.common import Steps, free_name, prepare, table
from gapline.session import configure

PIECE_MODEL = "piece_bpe_32k.model"


def _ready(spark: SparkSession) -> SparkSession:
    return prepare(configure(spark))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(Steps(_ready(spark)), docs, table(spark, sf_dir, "labels"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(Steps(_ready(spark)), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.stage(Steps(_ready(spark)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(docs, table(_ready(spark), sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    name = free_name(docs, "pieces")
    rows = sentencepiece_bridge.encode(docs, name, public_tokenizers.path(PIECE_MODEL), with_ids=True)
    fields = ("ids", "n_tokens", "ids_crc32", "differing", "round_trip")
    return rows.select(*docs.columns, *[F.col(name)[f].alias(free_name(docs, f)) for f in fields])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_ids),
]

#: The binomial bounds, XXH64 votes and BPE merges are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    steps = Steps(_ready(spark))
    for _, stage in STAGES:
        docs = steps.store(stage(spark, docs, sf_dir))
    return docs
