"""Tokenizing with a public byte-level BPE vocabulary, whose path is a parameter; the driver reads it and ships it once."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ship(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (under 1 MB) as a broadcast, so that workers need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: pa.Array, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All token ids, one text after another, and the number of each text. A null or empty text has none."""
    enc = _encoding(raw)
    ids = [enc.encode_ordinary(t) if t else [] for t in texts.to_pylist()]
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.empty(int(n.sum()), dtype=np.int32)
    at = 0
    for x in ids:
        flat[at : at + len(x)] = x
        at += len(x)
    return flat, n


def decode(ids: list[int], raw: bytes) -> str:
    return _encoding(raw).decode(list(ids))
