"""Algebra of dense arrays and sparse vectors as column expressions.

Cosines divide with try_divide: a zero vector has no score (null), and NaN never reaches a comparison.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "angle", "dot", "norm_a", "norm_b", "euclidean", "manhattan", "projection", "overlap", "jaccard")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dense(values: Column) -> Column:
    return values.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product of dense arrays over the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(dense(a), 1, n), F.slice(dense(b), 1, n), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(dense(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(dense(a), dense(b), lambda x, y: F.abs(x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(dense(a), dense(b), lambda x, y: (x - y) * (x - y))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(dense(a), dense(b), lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(dense(a), lambda x: F.try_divide(x, by))


def normalize(a: Column) -> Column:
    return scale(a, norm(a))


def rounded(a: Column, digits: int) -> Column:
    """Rounded half away from zero; what is rounded to zero keeps its sign, as SQL engines have it and Spark's round, by way of decimals, has not."""
    r = F.round(a, digits)
    return F.when(r == 0, a * F.lit(0.0)).otherwise(r)


def approximates(left: Column, right: Column, precision: float) -> Column:
    return F.abs(left - right) < precision


def signature(a: Column, b: Column) -> Column:
    """The ten metrics of a pair of dense arrays of one length, as a struct.

    The cosine is 0 where a norm or the product is 0, and clamped to [-1, 1].
    """
    d, na, nb = dot(a, b), norm(a), norm(b)
    cos = F.greatest(F.least(F.coalesce(F.try_divide(d, na * nb), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    both = F.zip_with(dense(a), dense(b), lambda x, y: F.struct((x != 0).alias("x"), (y != 0).alias("y")))
    overlap = F.size(F.filter(both, lambda z: z["x"] & z["y"])).cast("double")
    union = F.size(F.filter(both, lambda z: z["x"] | z["y"])).cast("double")
    parts = (cos, F.acos(cos), d, na, nb, euclidean(a, b), manhattan(a, b), F.coalesce(F.try_divide(d, nb), F.lit(0.0)), overlap, F.coalesce(F.try_divide(overlap, union), F.lit(0.0)))
    return F.struct(*[p.alias(n) for p, n in zip(parts, METRICS)])


def angle_of(metrics: list[Column], dims: Column) -> Column:
    """Cosine of a signature, taken as a vector of ``dims``, with the unit vector: sum over root of dims times norm."""
    total = squares = F.lit(0.0)
    for c in metrics:
        total, squares = total + c, squares + c * c
    return F.try_divide(total, F.sqrt(dims) * F.sqrt(squares))


def angle_key(vector: Column) -> Column:
    """Key of a sparse vector of unit norm: the angle of its signature against the unit vector, in closed form.

    Rounded to 12 decimals, which is far finer than keys of different vectors differ: words of the same letters in another order can have keys
    that are equal but for the order in which floating-point numbers were added.
    """
    values, dims = vector["values"], vector["size"].cast("double")
    u = 1.0 / F.sqrt(dims)
    s, nnz = _sum(values), F.size(values).cast("double")
    na = F.sqrt(_sum(F.transform(values, lambda v: v * v)))
    d = s * u
    cos = F.greatest(F.least(F.coalesce(F.try_divide(d, na), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    euclid = F.sqrt(F.greatest(na * na + 1 - 2 * d, F.lit(0.0)))
    manhattan_ = _sum(F.transform(values, lambda v: F.abs(v - u))) + (dims - nnz) * u
    return F.round(angle_of([cos, F.acos(cos), d, na, F.lit(1.0), euclid, manhattan_, d, nnz, nnz / dims], dims), 12)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of sparse vectors, by a map from one's indices."""
    of = F.map_from_arrays(b["indices"], b["values"])
    d = _sum(F.zip_with(a["indices"], a["values"], lambda i, x: x * F.coalesce(F.try_element_at(of, i), F.lit(0.0))))
    return F.try_divide(d, norm(a["values"]) * norm(b["values"]))


def unit_cosine(vector: Column) -> Column:
    """Cosine of a sparse vector with the unit vector."""
    return F.try_divide(_sum(vector["values"]), F.sqrt(vector["size"].cast("double")) * norm(vector["values"]))


def long_form(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys..., idx, val) of a sparse vector column."""
    pairs = F.arrays_zip(F.col(f"{vector}.indices").alias("idx"), F.col(f"{vector}.values").alias("val"))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.idx").alias("idx"), F.col("p.val").alias("val"))


def vector_sum(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums vectors in long form (keys..., idx, val)."""
    return rows.groupBy(*keys, "idx").agg(F.sum("val").alias("val"))


def encode(indices: list[int], values: list[float], kind: str = "d") -> bytes:
    """Bytes of a sparse vector: count, indices, values ('d' double, 'f' float), little-endian."""
    if len(indices) != len(values):
        raise ValueError("as many values as indices are needed")
    return struct.pack(f"<i{len(indices)}i{len(values)}{kind}", len(indices), *indices, *values)


def decode(raw: bytes, kind: str = "d") -> tuple[list[int], list[float]]:
    """The vector of :func:`encode`; raises where the length doesn't fit the count."""
    (n,) = struct.unpack_from("<i", raw)
    if len(raw) != 4 + n * (4 + struct.calcsize(kind)):
        raise ValueError("the values have another size")
    parts = struct.unpack(f"<{n}i{n}{kind}", raw[4:])
    return list(parts[:n]), list(parts[n:])


def encode_column(vector: Column, kind: str = "d") -> Column:
    """The same bytes for a column of sparse vectors, by an Arrow UDF."""
    @F.pandas_udf("binary")
    def code(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([encode(list(i), list(v), kind) for i, v in zip(rows["indices"], rows["values"])])

    return code(vector)


def decode_column(raw: Column, dims: int, kind: str = "d") -> Column:
    """Sparse vectors of a column of bytes."""
    @F.pandas_udf("size int, indices array<int>, values array<double>")
    def read(rows: pd.Series) -> pd.DataFrame:
        found = [decode(x, kind) for x in rows]
        return pd.DataFrame({"size": [dims] * len(found), "indices": [i for i, _ in found], "values": [v for _, v in found]})

    return read(raw)
