"""What the corpus operators share: identifiers of any type, the caller's rows, row labels and batch slicing.

Every operator takes a table whose identifier and text columns are named by parameters. Where an operator gives the
caller's rows back, it carries each as one struct beside its own columns, so no name of a caller's column can clash with them.
Identifiers of a whole-number type are handled as bigint, all others by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmesh.functions.storage import Scratch, materialize, new_path, remove, setting, shared_dir, write

__all__ = ["Scratch", "col", "id_types", "identified", "materialize", "mix", "new_path", "ranges", "remove", "row_label", "setting", "shared_dir", "slices", "with_rows", "write"]
SLICE_BYTES = 4 << 20


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_types(docs: DataFrame, key: str) -> tuple[str, pa.DataType]:
    """How identifiers are carried, in Spark's and in Arrow's words."""
    kind = docs.select(col(key)).schema[0].dataType
    return ("bigint", pa.int64()) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)) else ("string", pa.string())


def row_label(text: str) -> Column:
    """Tells rows that carry one identifier apart; equal rows share it, and 0 stands for null."""
    return F.coalesce(F.xxhash64(col(text).cast("string")), F.lit(0))


def identified(docs: DataFrame, key: str, text: str, label: bool = True) -> DataFrame:
    """(id, label, text) of each row."""
    more = [row_label(text).alias("label")] if label else []
    return docs.select(col(key).cast(id_types(docs, key)[0]).alias("id"), *more, col(text).cast("string").alias("text"))


def with_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row of the caller as the struct ``row``, and columns made from it; ``select("row.*")`` gives it back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of text, so that Python memory stays bounded."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(starts, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
