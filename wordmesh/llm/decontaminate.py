"""Operator 7: benchmark decontamination.

All word n-grams of the benchmark, normalized (lower case, words of letters, digits and underscores), are put in a
hash set that is broadcast while its text is under a checked size; a larger benchmark is cut into parts of that size, each with a
set of its own, and some parts are scanned in one pass. An item of fewer words than n is one gram of its own length. A document's windows
are hashed and looked up, hits are verified word by word. Words under a hit are removed with what stands before each, or the
whole document where they make up half of it. Documents are read in narrow passes; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmesh.llm.common import Scratch, col, id_types, mix, slices, with_rows
from wordmesh.llm.words import WORD, lower, split

N = 8
#: Items of fewer words say nothing of contamination ("yes", "the cat") and are never looked for.
SHORTEST = 3
MOST_SHARE = 0.5
#: Text of one broadcast set, which takes some ten times as much memory, and sets in one pass.
BROADCAST_BYTES = 32 << 20
PARTS_IN_A_PASS = 4


@dataclass
class Grams:
    """Words of the benchmark by number, and for each length its distinct grams in the order of their hashes."""

    words: dict[str, int]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


def _window_hashes(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h)


def _windows(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return ids[at[:, None] + np.arange(n)]


def grams_of(items: list[str], n: int = N, shortest: int = SHORTEST) -> Grams:
    """The set of n-grams of the items, and those of fewer words whole; items of fewer than ``shortest`` words have none."""
    words: dict[str, int] = {}
    found: dict[int, list[np.ndarray]] = {}
    for t in items:
        ids = np.array([words.setdefault(w, len(words)) for w in split(t)], dtype=np.int32)
        k = min(n, len(ids))
        if k >= shortest:
            found.setdefault(k, []).append(_windows(ids, np.arange(len(ids) - k + 1), k))
    tables = {}
    for k, rows in found.items():
        rows = np.unique(np.concatenate(rows), axis=0)
        h = _window_hashes(rows)
        order = np.argsort(h, kind="stable")
        tables[k] = (h[order], rows[order])
    return Grams(words, tables)


def word_hits(texts: list[str | None], g: Grams) -> list[np.ndarray]:
    """For each text whether each word is under a verified hit."""
    get = g.words.get
    tokens = [np.fromiter((get(w, -1) for w in split(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    size = np.array([len(x) for x in tokens], dtype=np.int64)
    ids = np.concatenate([x for t in tokens for x in (t, np.full(1, -1, np.int32))]) if tokens else np.zeros(0, np.int32)
    out = np.zeros(len(ids) + 1, np.int64)
    gaps = np.concatenate([[0], np.cumsum(ids < 0)])
    for n, (hashes, rows) in g.tables.items():
        if len(ids) < n:
            continue
        at = np.flatnonzero(gaps[n:] == gaps[:-n])
        windows = _windows(ids, at, n)
        h = _window_hashes(windows)
        place = np.searchsorted(hashes, h)
        some = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h)
        while some.size:  # grams that share a hash are tried one after another
            real = at[some[(rows[place[some]] == windows[some]).all(axis=1)]]
            np.add.at(out, real, 1)
            np.add.at(out, real + n, -1)
            place[some] += 1
            some = some[place[some] < len(hashes)]
            some = some[hashes[place[some]] == h[some]]
    under = np.cumsum(out) > 0
    starts = np.cumsum(size + 1) - size - 1
    return [under[a : a + k] for a, k in zip(starts.tolist(), size.tolist())]


def spans_of(under: np.ndarray) -> list[tuple[int, int]]:
    """The runs of words under hits, as (first, one past the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], under.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands before each of them. Lower case keeps every character's place."""
    ends = [0, *(m.end() for m in WORD.finditer(lower(text)))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : ends[a]])
        at = ends[b]
    return "".join(out) + text[at:]


def _parts(benchmark: DataFrame, text: str, limit: int) -> Iterator[list[str]]:
    """The benchmark's distinct texts in parts of at most ``limit`` bytes each (or one text)."""
    part, size = [], 0
    for r in benchmark.select(col(text).cast("string").alias("t")).filter("t is not null").distinct().orderBy("t").toLocalIterator():
        if part and size + len(r.t) > limit:
            yield part
            part, size = [], 0
        part.append(r.t)
        size += len(r.t)
    yield part


def scan(rows: DataFrame, benchmark: DataFrame, benchmark_text: str = "text", n: int = N, most_share: float = MOST_SHARE, limit: int = BROADCAST_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """``rows``, one column of which is ``text``, with words, hits (words under hits), spans and clean, which they must not have.

    clean is null where the document is to go and the text itself where nothing was hit. A null or empty text has no words
    and is left as it is, as are all where the benchmark is empty; equal texts get equal results; very long ones are read whole,
    in slices of rows. Spans of earlier passes are joined with later ones, so the order of parts doesn't matter.
    """
    spark = rows.sparkSession
    extra = [T.StructField("words", T.IntegerType()), T.StructField("hits", T.IntegerType()), T.StructField("spans", T.StringType()), T.StructField("clean", T.StringType())]
    schema = T.StructType(rows.schema.fields + extra)
    first, s = True, Scratch(spark, "hits")
    parts = _parts(benchmark, benchmark_text, limit)
    part = next(parts)
    while part is not None:
        shared = []
        while part is not None and len(shared) < PARTS_IN_A_PASS:
            shared.append(spark.sparkContext.broadcast(grams_of(part, n, shortest)))
            part = next(parts, None)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text"):
                    texts = b.column("text").to_pylist()
                    before = [None] * len(texts) if first else b.column("spans").to_pylist()
                    found = word_hits(texts, shared[0].value)
                    for g in shared[1:]:
                        found = [x | y for x, y in zip(found, word_hits(texts, g.value))]
                    counts, hits, spans, clean = [], [], [], []
                    for t, under, old in zip(texts, found, before):
                        for x in old.split(",") if old else ():
                            under[int(x.split("-")[0]) : int(x.split("-")[1])] = True
                        k = int(under.sum())
                        s = spans_of(under) if k else []
                        counts.append(len(under))
                        hits.append(k)
                        spans.append(",".join(f"{a}-{z}" for a, z in s))
                        clean.append(t if not k else None if k >= most_share * len(under) else cut(t, s))
                    new = [pa.array(counts, pa.int32()), pa.array(hits, pa.int32()), pa.array(spans, pa.string()), pa.array(clean, pa.string())]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(b.columns) if first else -4], *new], names=schema.names)

        rows, first = (rows if first else s.table(rows, "hits")).mapInArrow(run, schema), False
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", benchmark_text: str = "text", n: int = N) -> DataFrame:
    """The documents that were hit: their words, those under hits, the spans, what is done, and the text that is left.

    Identifiers may be null or of any type; repeated rows are each reported; an empty table gives no rows. Only the two named columns
    are read, so others' names don't matter. All else as :func:`scan` says.
    """
    own = docs.select(col(key).cast(id_types(docs, key)[0]).alias("doc_id"), col(text).cast("string").alias("text"))
    return scan(own, benchmark, benchmark_text, n).filter("hits > 0").select(
        "doc_id", F.col("words").alias("n_words"), F.col("hits").alias("n_hit"), "spans", F.when(F.col("clean").isNull(), "drop").otherwise("cut").alias("action"), F.col("clean").alias("clean_text")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", benchmark_text: str = "text") -> DataFrame:
    """``docs`` without the documents that go, the others' texts cleaned and n_chars, where there is such a column, renewed.

    All other columns stay as they are, whatever their names; so do null and empty texts and repeated rows; an empty table stays empty.
    """
    columns = docs.columns
    out = scan(with_rows(docs, text=col(text).cast("string")), benchmark, benchmark_text).filter("hits = 0 or clean is not null")
    hit = F.col("hits") > 0
    new = {text: F.when(hit, F.col("clean")).otherwise(F.col("text"))}
    if "n_chars" in columns and text != "n_chars":
        new["n_chars"] = F.when(hit, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns])


CONTAMINATED_SQL = f"""
WITH b AS (SELECT list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS t FROM benchmark),
bg AS (SELECT DISTINCT {N} AS n, array_to_string(t[i:i + {N - 1}], ' ') AS g FROM (SELECT t, unnest(range(1, len(t) - {N - 2})) AS i FROM b WHERE len(t) >= {N})
       UNION SELECT len(t), array_to_string(t, ' ') FROM b WHERE len(t) BETWEEN {SHORTEST} AND {N - 1}),
sizes AS (SELECT DISTINCT n FROM bg),
d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS t FROM documents),
h AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, sizes WHERE len(t) >= n))
      WHERE g IN (SELECT g FROM bg)),
u AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
s AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM u) GROUP BY doc_id, k),
c AS (SELECT doc_id, string_agg((a - 1) || '-' || (z - 1), ',' ORDER BY a) AS spans, sum(z - a) AS n_hit FROM s GROUP BY doc_id),
x AS (SELECT d.doc_id, unnest(regexp_extract_all(d.text, '[^\\p{{L}}\\p{{N}}_]*[\\p{{L}}\\p{{N}}_]+')) AS piece, unnest(range(1, len(d.t) + 1)) AS p FROM d JOIN c USING (doc_id)),
k AS (SELECT x.doc_id, string_agg(piece, '' ORDER BY x.p) AS rest FROM x LEFT JOIN u ON u.doc_id = x.doc_id AND u.p = x.p WHERE u.p IS NULL GROUP BY x.doc_id)
SELECT c.doc_id, CAST(len(d.t) AS INTEGER) AS n_words, CAST(n_hit AS INTEGER) AS n_hit, spans, CASE WHEN n_hit >= {MOST_SHARE} * len(d.t) THEN 'drop' ELSE 'cut' END AS action,
       CASE WHEN n_hit < {MOST_SHARE} * len(d.t) THEN coalesce(rest, '') || regexp_extract(text, '[^\\p{{L}}\\p{{N}}_]*$') END AS clean_text
FROM c JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""
