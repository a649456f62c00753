"""Hashed sparse feature vectors of words.

A word's vector depends on the word and the number of dimensions only, so callers featurize distinct words. Words of one
length are featurized together as a matrix of code units; contributions are added in one fixed order, so a
word has bit-equal vectors wherever it is computed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmesh.functions.hashing import OFFSET, PRIME, ROLLING, bucket, units

_CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Zs Zl Zp Cc Cf Cs Co Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Cn".split()
_NUMBER = re.compile(r"[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: Words whose vectors a task keeps.
KNOWN = 100_000
_SPECIAL = {"infinity": float("inf"), "+infinity": float("inf"), "-infinity": float("-inf"), "nan": float("nan"), "+nan": float("nan"), "-nan": float("nan")}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Category number, lower case and upper case of each code unit."""
    chars = [chr(c) for c in range(0x10000)]
    number = {c: i for i, c in enumerate(_CATEGORIES)}
    category = np.array([number[unicodedata.category(c)] for c in chars])
    one = lambda c, f: ord(f(c)) if len(f(c)) == 1 and ord(f(c)) < 0x10000 else ord(c)
    return category, np.array([one(c, str.lower) for c in chars]), np.array([one(c, str.upper) for c in chars])


def parse_number(text: str, thousands: bool = True) -> float | None:
    """The number a text stands for, in the invariant culture, or None."""
    s = text.strip()
    if s.lower() in _SPECIAL:
        return _SPECIAL[s.lower()]
    if not _NUMBER.fullmatch(s) or (not thousands and "," in s):
        return None
    return float(s.replace(",", ""))


def is_number(text: str) -> bool:
    return parse_number(text) is not None


def _coordinate(text: str) -> tuple[float, str] | None:
    """A decimal number with a hemisphere letter or ''."""
    s, side = text.strip(), ""
    if s and s[-1] in "NSEWnsew":
        side, s = s[-1].upper(), s[:-1].rstrip()
    value = parse_number(s)
    return None if value is None else (value, side)


def is_geo(text: str) -> bool:
    """Whether a text is a longitude, a latitude or a pair of them, as decimals or as degrees, minutes and seconds."""
    lat, lon = (lambda v: -90 <= v <= 90), (lambda v: -180 <= v <= 180)
    at = text.find(",") if "," in text else text.find(" ")
    if at > 0 or (at == 0 and text[0] == ","):
        a, b = _coordinate(text[:at]), _coordinate(text[at + 1 :])
        if a and b and lat(a[0]) and lon(b[0]) and a[1] in ("", "N", "S") and b[1] in ("", "E", "W"):
            return True
    if one := _coordinate(text):
        if one[1]:
            return lat(one[0]) if one[1] in "NS" else lon(one[0])
        if lon(one[0]):
            return True
    at = text.find("°")
    if at <= 0:
        return False
    head, last = text[:at], text[-1].upper()
    degrees = parse_number(head, thousands=False)
    if degrees is not None and 0 <= degrees <= 180 and ("'" in text[at:] or '"' in text[at:]):
        return degrees <= 90 if last in "NS" else True
    if not all(unicodedata.category(c) == "Nd" for c in head) or not head.isascii() or len(head) not in (5, 6, 7):
        return False
    whole, minutes, seconds = int(head[:-4]), int(head[-4:-2]), int(head[-2:])
    if minutes >= 60 or seconds >= 60:
        return False
    return whole + minutes / 60 + seconds / 3600 <= (90 if last in "NS" else 180)


def _hash(columns: list, dims: int, count: int) -> np.ndarray:
    h = np.full(count, OFFSET, np.uint64)
    for c in columns:
        h = (h ^ np.asarray(c, dtype=np.uint64)) * np.uint64(PRIME)
    return (h % np.uint64(dims)).astype(np.int64)


def featurize(labels: list[str], dims: int = 512, block: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each label, indices ascending, of unit norm; empty for an empty label."""
    out: list = [(np.zeros(0, np.int32), np.zeros(0))] * len(labels)
    by_length = defaultdict(list)
    for i, s in enumerate(labels):
        by_length[len(units(s)) if s else 0].append(i)
    for n, places in by_length.items():
        if n:
            for a in range(0, len(places), block):
                part = places[a : a + block]
                for i, v in zip(part, _same_length([labels[i] for i in part], n, dims)):
                    out[i] = v
    return out


def _same_length(labels: list[str], n: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    s = np.array([units(x) for x in labels], dtype=np.int64)
    m, rows = len(labels), np.arange(len(labels))
    category, lower, upper = _tables()
    word = np.zeros((m, dims))

    def add(index: np.ndarray | int, weight, which: np.ndarray | None = None) -> None:
        index = np.broadcast_to(index, m)
        if which is None:
            word[rows, index] += weight
        else:
            word[rows[which], index[which]] += weight

    def joined(prefix: str, columns: list) -> np.ndarray:
        return (bucket(prefix, dims) + _hash(columns, dims, m)) % dims

    word[:, : min(n, dims)] = s[:, : min(n, dims)]
    for size in (3, 4, 5):
        for i in range(n - size + 1):
            add(_hash([s[:, i + k] for k in range(size)], dims, m), 1.0)
    for prefix, gap, weight in (("bg:", 1, 0.75), ("sg1:", 2, 0.5)):
        for i in range(n - gap):
            add(joined(prefix, [s[:, i], s[:, i + gap], np.full(m, i & 255), np.full(m, i >> 8 & 255)]), weight)
    pad = np.full(m, ord("_"))
    cells = [s[:, i] for i in range(n)]
    add(joined("tri:start:", (cells + [pad, pad])[:3]), 0.65)
    add(joined("tri:end:", ([pad, pad] + cells)[-3:]), 0.65)
    add(joined("first:", [s[:, 0]]), 0.75)
    add(joined("last:", [s[:, -1]]), 0.75)
    add(bucket(f"len:{n}" if n <= 4 else "len:5-8" if n <= 8 else "len:9-16" if n <= 16 else "len:17+", dims), 0.5)
    kinds = category[s]
    vowel = np.isin(lower[s], [ord(c) for c in "aeiouy"])
    pattern = np.where(kinds <= 4, np.where(vowel, ord("V"), ord("C")), ord("X"))
    add(joined("vc:", [pattern[:, i] for i in range(n)]), 0.5)
    if n <= 3:
        h = np.zeros(m, np.uint64)
        for c in cells:
            h = (h ^ c.astype(np.uint64)) * np.uint64(ROLLING)
        add((h % np.uint64(dims)).astype(np.int64), 0.8)
    low, up = (lower[s] == s).all(axis=1), (upper[s] == s).all(axis=1)
    add(np.where(low, bucket("case:lower", dims), bucket("case:mixed", dims)), 0.5)
    add(bucket("case:upper", dims), 0.5, up)
    add(bucket("case:title", dims), 0.5, kinds[:, 0] == 0)
    of_kind = np.array([(bucket("uc:", dims) + bucket(f"{k % 10}{k // 10}", dims)) % dims for k in range(len(_CATEGORIES))])
    for i in range(n):
        add(of_kind[kinds[:, i]], 0.25)
    for prefix, test in (("feat:number:", is_number), ("feat:geo:", is_geo)):
        yes = np.array([test(x) for x in labels])
        add(np.where(yes, (bucket(prefix, dims) + bucket("is", dims)) % dims, (bucket(prefix, dims) + bucket("not", dims)) % dims), 0.6)
    out = []
    for row in word:
        at = np.flatnonzero(row)
        v = row[at]
        out.append((at.astype(np.int32), v / np.sqrt((v * v).sum())))
    return out


def vectors(labels: DataFrame, label: str = "label", dims: int = 512, *keep: str) -> DataFrame:
    """(label, vector) of the distinct labels of a table; with columns to keep, of each of its rows."""
    kind = pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    own = labels.select(F.col(label).alias("label"), *keep).filter("label is not null")
    own = own if keep else own.distinct()
    schema = T.StructType(own.schema.fields + [T.StructField("vector", T.StructType.fromDDL("size int, indices array<int>, values array<double>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                found = featurize(b.column(0).to_pylist(), dims)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in found])]), pa.int32())
                indices = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([i for i, _ in found]), pa.int32()))
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([v for _, v in found])))
                vector = pa.StructArray.from_arrays([pa.array([dims] * len(found), pa.int32()), indices, values], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*b.columns, vector], names=[*b.schema.names, "vector"])

    return own.mapInArrow(run, schema)


def sums(rows: DataFrame, dims: int, unit: bool, schema: str) -> DataFrame:
    """(key, idx, val): the sum of the vectors of each row's ``words``, of unit norm with ``unit``. A task keeps the vectors of words it met, up to KNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in _runs(np.asarray(pc.list_value_length(batch.column("words")))):
                part = batch.slice(a, b - a)
                lists = part.column("words")
                coded = lists.flatten().dictionary_encode()
                names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
                if len(known) > KNOWN:
                    known.clear()
                new = [x for x in names if x not in known]
                known.update(zip(new, featurize(new, dims)))
                found = [known[x] for x in names]
                size = np.array([len(i) for i, _ in found])
                start = np.cumsum(size) - size
                index, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                row = np.repeat(np.arange(b - a), np.asarray(pc.list_value_length(lists)))
                pair, n = np.unique(row * len(names) + code, return_counts=True)
                row, code = np.divmod(pair, len(names))
                total = np.zeros((b - a, dims))
                for c in range(0, len(row), 1 << 15):
                    r, w = row[c : c + (1 << 15)], code[c : c + (1 << 15)]
                    many = size[w]
                    at = np.repeat(start[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    np.add.at(total.reshape(-1), np.repeat(r, many) * dims + index[at], np.repeat(n[c : c + (1 << 15)], many) * value[at])
                if unit:
                    total /= np.sqrt((total * total).sum(axis=1))[:, None]
                r, i = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(r)), pa.array(i.astype(np.int32)), pa.array(total[r, i])], names=["key", "idx", "val"])

    return rows.select("key", "words").mapInArrow(run, schema)


def _runs(lengths: np.ndarray, words: int = 1 << 16, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` lists that end when they have ``words`` words."""
    part = np.maximum(np.cumsum(lengths) // words, np.arange(len(lengths)) // rows) if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def geo_flags(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, number, geo) of raw strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x is not None and is_number(x) for x in names]), pa.array([bool(x) and is_geo(x) for x in names])], names=["label", "number", "geo"])

    return labels.select(F.col(label).alias("label")).mapInArrow(run, "label string, number boolean, geo boolean")


def as_text(values: Column) -> Column:
    """A vector's values, each rounded to an even whole number, as characters."""
    return F.array_join(F.transform(values, lambda v: F.decode(F.unhex(F.lpad(F.hex(F.rint(v).cast("bigint")), 4, "0")), "UTF-16BE")), "")
