"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of its input, but for
the last, which returns packed pieces. ``run`` writes each stage's result to the shared folder and reads it again.

No stage minds nulls in any column, empty or very long texts, ties, repeated rows, an empty table, or columns of any name beside
its own; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmesh.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from wordmesh.llm.common import Scratch


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language can't be told go: null, empty and mixed texts; with no label at all, every document. Repeated rows share one fate."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, that of the least identifier, null ones last; null texts are equal, and so are empty ones. Of repeated rows one stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least identifier stays, null ones last; wordless and null texts are in no group and stay."""
    return near_dedup.deduplicate(docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of which they make up half go. Null and empty texts stay, as do all with an empty benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token sequences of power-of-two lengths, written in buckets of equal ones. Null and empty texts give none; repeated rows each do."""
    return packing.pack_buckets(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_texts),
    ("packing", pack_sequences),
]

#: Language ID by trained classifiers and BPE tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; an empty one gives no pieces. A stage's input is removed when its result is written."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, s.settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        s.drop(before)
    return docs
