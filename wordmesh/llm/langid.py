"""Operator 6: language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary classifier over hashed byte n-grams (a naive Bayes model,
its margin scaled to unit spread) tells the languages with 1 from those with 0. A text's margins are compared with
every codeword under a logistic loss weighted by how well each bit did on rows held out; the least loss names the language, and
where the next is nearly as small the text is flagged as ambiguous. The models are fitted on a sample of at most ``per_language``
labelled rows a language, the only bound here: those rows are read whole where they are, and the driver gets their counts of hashed n-grams and
their margins only. Each text is then read whole, in one narrow pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmesh.llm.common import Scratch, col, id_types, slices, with_rows

PER_LANGUAGE = 400
#: Shares of so many languages at most are broadcast; those of more are joined.
BROADCAST_LANGUAGES = 4096
ORDERS = (2, 3, 4)
HASH_BITS = 15
MIN_MARGIN = 0.03
BLOCK = 1 << 18


def codewords(k: int) -> np.ndarray:
    """k codewords of +-1: the exhaustive code up to five languages, else the best of random codes that a fixed seed gives."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=float).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    best, most = None, -1
    for _ in range(2000):
        m = rng.choice((1.0, -1.0), size=(k, bits))
        if (np.abs(m.sum(axis=0)) == k).any():
            continue
        d = ((bits - m @ m.T) / 2 + np.eye(k) * bits).min()
        if d > most:
            best, most = m, d
    return best


@dataclass
class Model:
    """languages; codewords (languages x bits); weights (orders, features, bits); scale and weight of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray


def _codes(raw: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams of bytes from each position on."""
    m = max(0, len(raw) - order + 1)
    x = np.zeros(m, np.uint32)
    for k in range(order):
        x = (x << np.uint32(8)) | raw[k : k + m]
    return (x * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case UTF-8 bytes of all texts end to end, and the bounds of each."""
    low = pc.utf8_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8) if len(low) else np.zeros(1, np.int64)
    data = low.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def margins(texts: pa.Array, model: Model) -> np.ndarray:
    """The scaled margin of each bit for each text; a text without n-grams has NaN. Memory is bounded whatever the length."""
    raw, ends = _bytes(texts)
    bits = model.code.shape[1]
    total, count = np.zeros((len(texts), bits)), np.zeros(len(texts))
    for o, order in enumerate(ORDERS):
        lo, hi = ends[:-1], np.maximum(ends[1:] - order + 1, ends[:-1])
        count += hi - lo
        for a in range(0, len(raw), BLOCK):
            b = min(len(raw), a + BLOCK)
            h = _codes(raw[a : b + order - 1], order)
            s = np.zeros((b - a + 1, bits), np.float32)
            s[: len(h)] = model.weights[o][h]
            i, j = np.searchsorted(hi, a, "right"), np.searchsorted(lo, b, "left")
            x, y = np.clip(lo[i:j], a, b) - a, np.clip(hi[i:j], a, b) - a
            some = y > x
            if some.any():
                at = np.stack([x[some], y[some]], axis=1).ravel()
                total[np.arange(i, j)[some]] += np.add.reduceat(s, at, axis=0)[::2]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total / count[:, None] - model.bias) / model.scale


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row of margins, and how much greater the next one's loss is; -1 and 0 for NaN."""
    w = model.bit_weight / model.bit_weight.sum()
    loss = np.stack([(np.logaddexp(0, -np.nan_to_num(m) * c) * w).sum(axis=1) for c in model.code], axis=1)
    best = loss.argmin(axis=1)
    ordered = np.sort(loss, axis=1)
    gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.ones(len(m))
    none = np.isnan(m).any(axis=1)
    return np.where(none, -1, best), np.where(none, 0.0, gap)


def _count(raw: np.ndarray) -> np.ndarray:
    """Occurrences of each order's hashed n-grams, order after order."""
    return np.concatenate([np.bincount(_codes(raw, order), minlength=1 << HASH_BITS) for order in ORDERS])


def _uncalibrated(names: list[str], counts: np.ndarray) -> Model:
    """The bits' weights from the counts (languages x orders x features)."""
    code = codewords(len(names))
    weights = np.zeros((len(ORDERS), 1 << HASH_BITS, code.shape[1]), np.float32)
    for o in range(len(ORDERS)):
        p = (counts[:, o] + 0.1) / (counts[:, o] + 0.1).sum(axis=1, keepdims=True)
        for b in range(code.shape[1]):
            one, zero = p[code[:, b] > 0], p[code[:, b] < 0]
            weights[o, :, b] = np.log(one.mean(axis=0) / (zero.mean(axis=0) if len(zero) else one.mean(axis=0)))
    return Model(names, code, weights, np.zeros(code.shape[1]), np.ones(code.shape[1]), np.ones(code.shape[1]))


def _calibrated(model: Model, m: np.ndarray, of: np.ndarray, held: np.ndarray) -> Model:
    """Centres and scales each bit's margins, and weighs bits by their errors on the rows held out."""
    code, ok = model.code, ~np.isnan(m).any(axis=1)
    m, of, held = m[ok], of[ok], held[ok]
    if len(m) and len(model.languages) > 1:
        target = code[of]
        up, down = [np.array([m[target[:, b] == s, b].mean() if (target[:, b] == s).any() else 0.0 for b in range(code.shape[1])]) for s in (1, -1)]
        model.bias, model.scale = (up + down) / 2, np.maximum((up - down) / 4, 1e-6)
        test = held if held.any() else np.ones(len(m), bool)
        wrong = (((m - model.bias) / model.scale * target)[test] <= 0).mean(axis=0)
        model.bit_weight = np.maximum(np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 0.05)
    return model


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Fits the bits on three of four rows and weighs them on the rest; None where there is no labelled row."""
    names = sorted(set(languages))
    if not names:
        return None
    of, held = np.array([names.index(x) for x in languages]), np.arange(len(texts)) % 4 == 3
    counts = np.zeros((len(names), len(ORDERS) << HASH_BITS))
    for t, k, out in zip(texts, of, held):
        if not out:
            counts[k] += _count(_bytes(pa.array([t]))[0])
    model = _uncalibrated(names, counts.reshape(len(names), len(ORDERS), -1))
    return _calibrated(model, margins(pa.array(texts), model), of, held)


def training_rows(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(lang, rank, text) of at most ``per_language`` labelled rows of each language: those of the least hashes of identifier and text, whatever their length.

    Repeated rows count once. A share of the hashes that surely holds enough rows is cut off first, by an approximate count of distinct ones.
    """
    own = docs.select(col(lang).cast("string").alias("lang"), F.xxhash64(F.lit(11), col(key), F.xxhash64(col(text))).alias("o"), col(text).cast("string").alias("text")).filter("lang is not null and text is not null")
    share = own.groupBy("lang").agg(F.approx_count_distinct("o").alias("n")).select(F.col("lang").alias("l"), (F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")) * 2.0**31).cast("bigint").alias("most"))
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    few = own.join(share, own["lang"] == share["l"]).filter(F.pmod("o", F.lit(2**31)) < F.col("most")).groupBy("lang", "o").agg(F.first("text").alias("text"))
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("o"))).filter(F.col("rank") <= per_language).select("lang", "rank", "text")


def _held(rank: pa.Array) -> np.ndarray:
    return np.asarray(rank) % 4 == 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): the n-grams of the rows that aren't held out; rows of a language stand together."""

    def batch_of(lang: str, total: np.ndarray) -> pa.RecordBatch:
        slot = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot, pa.int32()), pa.array(total[slot])], names=["lang", "slot", "n"])

    now, total = None, np.zeros(len(ORDERS) << HASH_BITS, np.int64)
    for b in batches:
        for lang, held, i in zip(b.column("lang").to_pylist(), _held(b.column("rank")).tolist(), range(b.num_rows)):
            if lang != now:
                if total.any():
                    yield batch_of(now, total)
                now, total = lang, np.zeros_like(total)
            if not held:
                total += _count(_bytes(b.column("text").slice(i, 1))[0])
    if total.any():
        yield batch_of(now, total)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the table's own labels, None where no row has one. Null texts and labels teach nothing, ties go by hash, repeated rows count once."""
    s = Scratch(docs.sparkSession, "training")
    rows = s.table(training_rows(docs, key, text, lang, per_language), "rows")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    number = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), len(ORDERS) << HASH_BITS))
    found = rows.mapInArrow(_counts, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts[[number[x] for x in found["lang"].to_pylist()], found["slot"].to_numpy()] = found["n"].to_numpy()
    model = _uncalibrated(names, counts.reshape(len(names), len(ORDERS), -1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                m = margins(b.column("text"), shared.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(_held(b.column("rank"))), flat], names=["lang", "held", "m"])

    got = rows.mapInArrow(judged, "lang string, held boolean, m array<double>").toArrow()
    m = np.array(got["m"].combine_chunks().flatten()).reshape(len(got), -1)
    model = _calibrated(model, m, np.array([number[x] for x in got["lang"].to_pylist()]), got["held"].to_numpy())
    s.drop(rows)
    return model


def identify(rows: DataFrame, model: Model | None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``rows``, one column of which is ``text``, with language, margin and ambiguous, which they must not have.

    A null or too short text, as any text without a model, has no language and is ambiguous; with one language known every other
    text is of it. Equal texts, repeated rows among them, get equal answers; ties between languages go to the first name; very long texts are
    summed up in blocks, whole; an empty table stays empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(rows.schema.fields + [T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch, "text"):
                if m is None:
                    best, gap = np.full(b.num_rows, -1), np.zeros(b.num_rows)
                else:
                    best, gap = decode(margins(b.column("text"), m), m)
                names = pa.array([m.languages[k] if k >= 0 else None for k in best.tolist()], pa.string())
                flag = (best < 0) | (gap < min_margin)
                yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(gap), pa.array(flag)], names=schema.names)

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Each document's language, margin and flag, by a model fitted on the table's own labels. Identifiers may be null or of any type."""
    model = train(docs, key, text, lang, per_language)
    own = docs.select(col(key).cast(id_types(docs, key)[0]).alias("doc_id"), col(text).cast("string").alias("text"))
    return identify(own, model, min_margin).select("doc_id", "language", "margin", "ambiguous")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those that are ambiguous; all their columns stay as they are, whatever their names."""
    rows = with_rows(docs, text=col(text).cast("string"))
    return identify(rows, train(docs, key, text, lang)).filter("not ambiguous").select("row.*")
