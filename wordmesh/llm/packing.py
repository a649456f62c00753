"""Operator 1: packing by power-of-two decomposition.

A document of n tokens is split along the binary digits of n into pieces of length 2^k, largest first; what exceeds
the largest length gives several largest pieces. Pieces of one length form a bucket, from which batches are made, so
no sequence is padded and none crosses documents. Pieces are made in one narrow pass over the text and shuffled once, to be written
bucket by bucket, each bucket over as many files as its bytes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import col, id_types, new_path, ranges, setting, slices
from wordmesh.llm.tokens import VOCABULARY, encode, ship

MAX_POWER = 13
_PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("bucket", pa.int32()), ("length", pa.int32()), ("tokens", pa.list_(pa.int32()))]


def decompose(n: np.ndarray, max_power: int = MAX_POWER) -> tuple[np.ndarray, np.ndarray]:
    """The powers of all pieces, document after document, and the number of pieces of each."""
    powers = np.arange(max_power, -1, -1)
    times = (n[:, None] >> powers[None, :]) & 1
    times[:, 0] = n >> max_power
    return np.repeat(np.tile(powers, len(n)), times.ravel()), times.sum(axis=1)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_power: int = MAX_POWER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, bucket, length, tokens): each document's pieces, length = 2^bucket.

    Concatenating a document's pieces in order gives its tokens. A null or empty text, as an empty table, has
    no pieces; a null identifier stays null, and identifiers may be of any type; repeated rows, as ties, are each packed; very long
    texts give more largest pieces. Only the two named columns are read, so others' names don't matter.
    """
    raw = ship(docs.sparkSession, vocabulary)
    name, kind = id_types(docs, key)
    schema = pa.schema([("doc_id", kind), *_PIECES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                flat, n = encode(b.column("text"), raw.value)
                bucket, count = decompose(n, max_power)
                ends = np.concatenate([[0], np.cumsum(1 << bucket)])
                of = np.repeat(np.arange(len(n)), count)
                start = ends[:-1] - np.repeat(np.cumsum(n) - n, count)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(of)), pa.array(ranges(count), pa.int32()), pa.array(start), pa.array(bucket, pa.int32()), pa.array(1 << bucket, pa.int32()), tokens], schema=schema
                )

    own = docs.select(col(key).cast(name).alias("id"), col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {name}, piece int, start bigint, bucket int, length int, tokens array<int>")


def write_buckets(pieces: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """Writes a folder for each bucket, pieces in each file in a random order that ``seed`` settles, and reads the table back.

    Spark splits a bucket's partition by its bytes and joins small ones (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so
    a bucket that holds most tokens is many tasks and files, and a small one is one.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    order = F.xxhash64(F.lit(seed), "doc_id", "piece", "start")
    placed = pieces.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", order)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):
        placed.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(pieces.schema).parquet(path).select(columns)


def pack_buckets(docs: DataFrame, key: str = "doc_id", text: str = "text", max_power: int = MAX_POWER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of :func:`pack`, read from buckets of equal lengths that it writes to the shared folder."""
    return write_buckets(pack(docs, key, text, max_power, vocabulary), new_path(docs.sparkSession, "buckets"))
