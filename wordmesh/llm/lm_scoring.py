"""Operator 2: stupid-backoff scores of all documents, computed relationally.

The n-grams of all documents, with their counts, are exploded and partitioned by hash; each partition sums its count
table and joins it to the n-grams that asked; the answers go back and are summed per document. Documents are taken in batches
of some 640,000 words, and rows of these relations are packed: one row holds the distinct n-grams of a batch
that fall in one hash bucket, sorted, as compressed byte planes of their differences (under 5 bytes an n-gram; a row an n-gram would shuffle
some 16). Where the corpus asks for more buckets than a batch can fill with rows worth their overhead, batches are split into coarse
buckets only; the rows of thousands of batches are then merged, split into fine buckets, answered, and divided among the batches again, so
rows stay dense and partitions small whatever the size. A document doesn't
vouch for itself: its own counts are taken off before it is scored, so a backoff happens where other documents lack the n-gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch, id_types, identified, mix, ranges, slices
from wordmesh.llm.words import word_hashes

ORDER = 3
ALPHA = 0.4
BATCH_WORDS = 640_000
BUCKET_GRAMS = 2_000_000
#: Bits of an n-gram's name inside its bucket, as long as bucket and name together have no more than 64.
BITS = 48
#: Bytes of a count.
COUNT = 6
#: A batch is split into 2^COARSE_BITS buckets at most.
COARSE_BITS = 12


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, first all of the lowest, then all of the next, and so on; compressed, behind their number."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(packed: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    raw = pa.decompress(packed[4:], n * width, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _batches(kind: pa.DataType):
    """Packs documents into batches: identifiers, numbers of words, vocabulary and words by number."""
    schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int32())), ("vocab", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, seq, words = TaskContext.get().partitionId(), [], 0, 0

        def packed() -> pa.RecordBatch:
            vocab, tokens = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            row = [[(place << 32) + seq], [[i for x in held for i in x[0]]], [np.concatenate([x[1] for x in held])], [planes(_deltas(vocab), 8)], [planes(tokens.astype(np.uint64), 4)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                h, n = word_hashes(b.column("text").to_pylist())
                held.append((b.column("id").to_pylist(), n, h))
                words += len(h)
                if words >= BATCH_WORDS:
                    yield packed()
                    held, words, seq = [], 0, seq + 1
        if held:
            yield packed()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One packed row at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _grams(row: dict, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... the hash of the n-gram that ends at each word, and whether there is one in the document."""
    words = np.cumsum(unplanes(row["vocab"], 8))[unplanes(row["tokens"], 4).astype(np.int64)]
    at = ranges(np.asarray(row["lengths"], dtype=np.int64)).astype(np.int32)
    h = mix(words)
    for k in range(1, order + 1):
        if k > 1:
            h[1:] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(k))
        yield h >> np.uint64(64 - bits), at >= k - 1


def _split(grams: np.ndarray, counts: np.ndarray, name_bits: int, n_buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Sorted grams and their counts by bucket: the buckets that have any, and the packed names and counts of each."""
    bounds = np.searchsorted(grams >> np.uint64(name_bits), np.arange(n_buckets + 1, dtype=np.uint64)) if name_bits < 64 else np.array([0, len(grams)])
    some = np.flatnonzero(np.diff(bounds)).tolist()
    grams = grams & np.uint64((1 << name_bits) - 1)
    parts = [(bounds[i], bounds[i + 1]) for i in some]
    return some, [planes(_deltas(grams[a:z]), -(-name_bits // 8)) for a, z in parts], [planes(counts[a:z], COUNT) for a, z in parts]


def _ask(order: int, bits: int, coarse: int):
    """Explodes a batch into (bucket, gram_order, batch, grams, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for k, (h, there) in enumerate(_grams(row, order, bits)):
                some, names, counts = _split(*np.unique(h[there], return_counts=True), bits - coarse, 1 << coarse)
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([k + 1] * n, pa.int32()), pa.array([row["batch"]] * n, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.binary())],
                    names=["bucket", "gram_order", "batch", "grams", "counts"],
                )

    return run


def _table(t: pa.Table, name_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The count table of a group of packed rows: grams and sums; for all rows, end to end, the place in it and the own count; where rows end."""
    grams = [np.cumsum(unplanes(x, -(-name_bits // 8))) for x in t.column("grams").to_pylist()]
    own = np.concatenate([unplanes(x, COUNT) for x in t.column("counts").to_pylist()])
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    return known, np.bincount(place, weights=own).astype(np.uint64), place, own, np.cumsum([len(g) for g in grams])[:-1]


def _answer(name_bits: int):
    """Sums a bucket's count table and joins it to the batches: for each n-gram asked, its count in all other batches."""

    def run(t: pa.Table) -> pa.Table:
        _, sums, place, own, cuts = _table(t, name_bits)
        others = pa.array([planes(x, COUNT) for x in np.split(sums[place] - own, cuts)], pa.binary())
        return pa.table([t.column("batch"), t.column("gram_order"), t.column("bucket"), others], names=["batch", "gram_order", "bucket", "others"])

    return run


def _merge(name_bits: int, fine: int):
    """Makes the rows of a chunk of batches in one coarse bucket one row for each fine bucket; the chunk stands for the batch."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket, order, chunk = (x.as_py() for x in key)
        known, sums, *_ = _table(t, name_bits)
        some, names, counts = _split(known, sums, name_bits - fine, 1 << fine)
        n = len(some)
        return pa.table(
            [pa.array([(bucket << fine) + i for i in some], pa.int32()), pa.array([order] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.binary())],
            names=["bucket", "gram_order", "batch", "grams", "counts"],
        )

    return run


def _divide(name_bits: int):
    """Divides a chunk's answers among its batches: what other chunks have, and what the other batches of the chunk have."""

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        _, sums, place, own, cuts = _table(asked, name_bits)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("others").to_pylist()))
        all_others = np.concatenate([unplanes(x, COUNT) for _, x in parts]) + sums
        others = pa.array([planes(x, COUNT) for x in np.split(all_others[place] - own, cuts)], pa.binary())
        return pa.table([asked.column("batch"), asked.column("gram_order"), asked.column("bucket"), others], names=["batch", "gram_order", "bucket", "others"])

    return run


def _answers(asked: DataFrame, bits: int, coarse: int, fine: int, chunks: int, s: Scratch) -> DataFrame:
    """(batch, gram_order, bucket, others) for each row of ``asked``, by way of fine buckets where there are any."""
    asked_sql, answer_sql = "bucket int, gram_order int, batch bigint, grams binary, counts binary", "batch bigint, gram_order int, bucket int, others binary"
    if not fine:
        return s.table(asked.groupBy("bucket", "gram_order").applyInArrow(_answer(bits - coarse), answer_sql), "answers")
    asked = s.table(asked.withColumn("chunk", F.pmod(F.xxhash64("batch"), F.lit(chunks))), "asked")
    merged = asked.groupBy("bucket", "gram_order", "chunk").applyInArrow(_merge(bits - coarse, fine), asked_sql)
    found = s.table(merged.groupBy("bucket", "gram_order").applyInArrow(_answer(bits - coarse - fine), answer_sql), "fine")
    back = found.select(F.shiftright("bucket", fine).alias("b"), F.col("gram_order").alias("o"), F.col("batch").alias("c"), "bucket", "others")
    out = s.table(asked.groupBy("bucket", "gram_order", "chunk").cogroup(back.groupBy("b", "o", "c")).applyInArrow(_divide(bits - coarse), answer_sql), "answers")
    s.drop(asked, found)
    return out


def _score(order: int, bits: int, total: int, alpha: float, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n_words", pa.int32()), ("log_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = np.asarray(row["lengths"], dtype=np.int64)
            doc, at = np.repeat(np.arange(len(n), dtype=np.int32), n), ranges(n).astype(np.int32)
            score, before = np.zeros(len(doc)), None
            for k, (h, there) in enumerate(_grams(row, order, bits)):
                parts = sorted((a["bucket"], a["others"]) for a in row["answers"] if a["gram_order"] == k + 1)
                left = np.zeros(len(doc), np.int64)  # for each word the count of the n-gram that ends there in other documents
                left[there] = _left_out(h[there], doc[there], np.concatenate([unplanes(p, COUNT) for _, p in parts]) if parts else None)
                dropped = np.minimum(at, order - 1) - k
                if k == 0:
                    score = np.log(np.maximum(left, 0.5) / np.maximum(total - n, 1)[doc]) + dropped * math.log(alpha)
                else:
                    hit = np.flatnonzero(left > 0)
                    score[hit] = np.log(left[hit] / before[hit - 1]) + dropped[hit] * math.log(alpha)
                before = left
            sums = np.bincount(doc, weights=score, minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(n, pa.int32()), pa.array(sums, mask=n == 0)], schema=schema)

    return run


def _left_out(h: np.ndarray, doc: np.ndarray, others: np.ndarray | None) -> np.ndarray:
    """Counts of n-grams in all documents but their own: those of other batches plus the batch's less the document's."""
    if others is None:
        return np.zeros(len(h), np.int64)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    own = new.copy()
    own[1:] |= doc[1:] != doc[:-1]
    out = np.empty(len(h), np.int64)
    sizes = [np.diff(np.append(np.flatnonzero(x), len(h))) for x in (new, own)]
    out[order] = np.repeat(others.astype(np.int64) + sizes[0], sizes[0]) - np.repeat(sizes[1], sizes[1])
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, bucket_grams: float = BUCKET_GRAMS) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), a row for each row of ``docs``.

    Of a word the longest n-gram (up to ``order``, inside the document) that other documents have gives count over count
    of its first n - 1 words, times ``alpha`` for each order dropped; at last the word's count, half an occurrence where
    others lack it, over their number of words. A null or wordless text has 0 words and null scores; null identifiers
    stay null, and identifiers may be of any type; repeated rows, as ties, are documents of their own and vouch for each other; a very long text
    is a batch of its own. An empty table gives no rows. Only the two named columns are read, so others' names don't matter.
    """
    s = Scratch(docs.sparkSession, "scores")
    name, kind = id_types(docs, key)
    packed = s.table(identified(docs, key, text, label=False).mapInArrow(_batches(kind), f"batch bigint, ids array<{name}>, lengths array<int>, vocab binary, tokens binary"), "batches")
    total = packed.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
    buckets = max(4, math.ceil(math.log2(max(1, total / bucket_grams))))
    coarse = min(buckets, COARSE_BITS)
    bits = min(64, BITS + buckets)
    chunks = max(1, math.ceil(total / 2**coarse / bucket_grams))
    asked = packed.select("batch", "ids", "lengths", "vocab", "tokens").mapInArrow(_ask(order, bits, coarse), "bucket int, gram_order int, batch bigint, grams binary, counts binary")
    answers = _answers(asked, bits, coarse, buckets - coarse, chunks, s)
    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("gram_order", "bucket", "others")).alias("answers"))
    joined = packed.join(gathered, "batch", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<gram_order:int,bucket:int,others:binary>>")))
    scored = joined.mapInArrow(_score(order, bits, total, alpha, kind), f"doc_id {name}, n_words int, log_score double")
    return s.finish(scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 5).alias("mean_log_score")))


SCORE_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t WHERE len(w) > 0),
g AS (SELECT doc_id, p, w[p] AS a, CASE WHEN p > 1 THEN w[p-1] || ' ' || w[p] END AS b, CASE WHEN p > 2 THEN w[p-2] || ' ' || w[p-1] || ' ' || w[p] END AS c FROM x),
n AS (SELECT count(*) AS n FROM g),
o AS (SELECT doc_id, p, count(a) OVER (PARTITION BY a) - count(a) OVER (PARTITION BY doc_id, a) AS c1,
             CASE WHEN b IS NULL THEN 0 ELSE count(b) OVER (PARTITION BY b) - count(b) OVER (PARTITION BY doc_id, b) END AS c2,
             CASE WHEN c IS NULL THEN 0 ELSE count(c) OVER (PARTITION BY c) - count(c) OVER (PARTITION BY doc_id, c) END AS c3,
             count(*) OVER (PARTITION BY doc_id) AS len FROM g),
q AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY p) AS b1, lag(c2) OVER (PARTITION BY doc_id ORDER BY p) AS b2 FROM o),
s AS (SELECT doc_id, sum(CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + (CASE WHEN p > 2 THEN 1 ELSE 0 END) * ln({ALPHA})
      ELSE ln(greatest(c1, 0.5) / greatest(n - len, 1)) + least(p - 1, 2) * ln({ALPHA}) END) AS s FROM q, n GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(w), 0) AS INTEGER) AS n_words, round(s, 3) AS log_score, round(s / nullif(len(w), 0), 5) AS mean_log_score FROM t LEFT JOIN s USING (doc_id)
"""
