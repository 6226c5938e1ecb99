"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept as Parquet; all but the last return the columns
of ``documents``.  The mix repeats documents, so ``doc_id`` may occur more than once after it.

Defined cases: columns beyond doc_id, text and source pass through all stages untouched, whatever
their names, but for ``n_chars``, which is counted anew once lines are gone; null and empty texts,
repeated rows, rows that share an id and empty tables are as each operator defines them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from ledgerlake.llm.queries import table, tokenizer_path
from ledgerlake.sources.shared import materialize


def _keeping_columns(docs: DataFrame, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate`` on the columns it reads; all others travel in one struct, where no name can clash."""
    read = [c for c in docs.columns if c.lower() in ("doc_id", "text", "source")]
    others = [c for c in docs.columns if c not in read]
    if not others:
        return operate(docs).select(*docs.columns)
    packed = docs.select(*read, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
    return operate(packed).select(*[F.col(f"_others.`{c}`") if c in others else F.col(c) for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _keeping_columns(docs, line_dedup.dedup_lines)
    if "n_chars" not in docs.columns:
        return left
    kind = docs.schema["n_chars"].dataType
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keeping_columns(docs, mixing.mix)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Tokenizing, learned rules and a random order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
