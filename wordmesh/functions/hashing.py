"""Hash functions: FNV-1a over UTF-16 code units or bytes, a rolling hash, and a Knuth-style name hash.

Spark's long arithmetic raises on overflow, so the 64-bit FNV state is kept as two 32-bit halves; the prime is
2^40 + 435, so a step needs two small products and a shift.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = 14695981039346656037, 1099511628211
ROLLING = 11400714819323198485
NAME_START, NAME_STEP = 3074457345618258791, 3074457345618258799
_M32 = (1 << 32) - 1
_M64 = (1 << 64) - 1


def units(text: str) -> list[int]:
    """The UTF-16 code units of a string."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return np.frombuffer(raw, "<u2").tolist()


def fnv(values) -> int:
    """FNV-1a 64 over numbers."""
    h = OFFSET
    for v in values:
        h = ((h ^ v) * PRIME) & _M64
    return h


def bucket(key: str, dims: int) -> int:
    return fnv(units(key)) % dims


def fnv_bytes(raw: bytes) -> int:
    """FNV-1a 64 over bytes as a signed long."""
    h = fnv(raw)
    return h - (1 << 64) if h >> 63 else h


def rolling(text: str) -> int:
    h = 0
    for u in units(text):
        h = ((h ^ u) * ROLLING) & _M64
    return h


def name_hash(name: str) -> int:
    """The unsigned 64-bit number of a collection's name."""
    h = NAME_START
    for u in units(name):
        h = ((h + u) * NAME_STEP) & _M64
    return h


def fnv_halves(values: Column) -> Column:
    """FNV-1a 64 over an array of numbers below 2^32, as struct<hi, lo> of 32-bit halves."""
    start = F.struct(F.lit(OFFSET >> 32).alias("hi"), F.lit(OFFSET & _M32).alias("lo"))

    def step(h: Column, c: Column) -> Column:
        x = h["lo"].bitwiseXOR(c.cast("bigint"))
        low = x * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(high.bitwiseAND(F.lit(_M32)).alias("hi"), low.bitwiseAND(F.lit(_M32)).alias("lo"))

    return F.aggregate(values, start, step)


def fnv_bucket(values: Column, dims: int) -> Column:
    """FNV-1a 64 modulo ``dims`` over an array of code units."""
    return F.aggregate(F.array(fnv_halves(values)), F.lit(0).cast("bigint"), lambda _, h: (F.pmod(h["hi"], F.lit(dims)) * ((1 << 32) % dims) + F.pmod(h["lo"], F.lit(dims))) % dims)


def code_units(text: Column) -> Column:
    """The code units of a string without characters beyond the basic plane."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
