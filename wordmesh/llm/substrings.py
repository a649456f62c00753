"""Operator 9: repeated passages by prefix-partitioned suffix trees.

A passage of 50 words or more that occurs twice is found through sampled suffixes: those that start where an 8-gram's hash is
the least of 32 in a row. Any 50 words hold such a start, at the same place in each copy and with 19 words or more behind it, so no repeat
is lost. Suffixes are counted by the hash of their first 16 words, and those that share it with no other are dropped before any text
moves. Those that are left bring 31 words of what stands before and 50 of what follows, enough for every 50-word window
around the start.

Prefixes are as long as a group needs to fit in memory. Most groups fit as they are. Where a prefix is shared by more suffixes than
that, equal surroundings are counted as one first; if too many different ones are left, the windows around the start are halved by
their offset, and each half goes by a longer prefix, namely the words that all its windows have in common: 35, 43, 47, 49, and at
last the 50 of a single window, whose suffixes are only counted, in partial sums. So no task holds more than a group, however often a passage occurs.

A task takes its suffixes in sorted order, that is, as the leaves of its subtrees; within a group doubling names the subtrees'
nodes, those of depth 50 that have two leaves or more are repeats, and overlapping ones of a document join to
maximal passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch, id_types, identified, mix, slices
from wordmesh.llm.words import _hash, gram_hashes

MIN_WORDS = 50
GRAM = 8
WINDOW = 32
PREFIX = 16
LEFT = WINDOW - 1
#: Most suffixes that a prefix may have before it is made longer.
GROUP_ROWS = 12_000
_ANCHOR = [("label", pa.int64()), ("pos", pa.int32()), ("prefix", pa.int64())]
_SEGMENT = [("label", pa.int64()), ("pos", pa.int32()), ("prefix", pa.int64()), ("n", pa.int64()), ("before", pa.string()), ("behind", pa.string())]
_RUN = [("label", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("copies", pa.int64()), ("first", pa.bool_())]
_SPAN = [("start_word", pa.int32()), ("end_word", pa.int32()), ("copies", pa.int64()), ("first", pa.bool_())]
_NODE = pa.schema([("sid", pa.int64()), ("sid2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("copies", pa.int64()), ("leads", pa.bool_())])


def _least(g: np.ndarray) -> np.ndarray:
    """Places whose value is the least of some ``WINDOW`` in a row, the leftmost of ties."""
    key = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return np.unique(key & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sampled suffixes of a text and the hashes of their first ``PREFIX`` words."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.array(list(map(_hash, words)), dtype=np.uint64)
    g = gram_hashes(h, GRAM)
    found, step = [], 1 << 22  # texts of millions of words in overlapping parts
    for a in range(0, max(1, len(g) - WINDOW + 1), step):
        found.append(_least(g[a : a + step + WINDOW - 1]) + a)
    at = np.unique(np.concatenate(found))
    at = at[at + PREFIX <= len(h)]
    far = mix(g[at] ^ mix(g[at + PREFIX - GRAM] + np.uint64(1)))
    return at, far


def anchors(own: DataFrame) -> DataFrame:
    """(id, label, pos, prefix) of every sampled suffix."""
    name, kind = id_types(own, "id")
    schema = pa.schema([("id", kind), *_ANCHOR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                found = [anchors_of(t.split() if t else []) for t in b.column("text").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                pos, prefix = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                yield pa.RecordBatch.from_arrays([b.column("id").take(of), b.column("label").take(of), pa.array(pos, pa.int32()), pa.array(prefix.view(np.int64))], schema=schema)

    return own.mapInArrow(run, f"id {name}, label bigint, pos int, prefix bigint")


def _segments(kind: pa.DataType):
    """Brings the words before and behind each suffix's start; n counts repeated rows."""
    schema = pa.schema([("id", kind), *_SEGMENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                of, pos, prefix, before, behind = [], [], [], [], []
                for i, r in enumerate(b.select(["text", "starts"]).to_pylist()):
                    w = r["text"].split()
                    for s in r["starts"]:
                        p = s["pos"]
                        of.append(i)
                        pos.append(p)
                        prefix.append(s["prefix"])
                        before.append(" ".join(w[max(0, p - LEFT) : p]))
                        behind.append(" ".join(w[p : p + MIN_WORDS]))
                take = pa.array(of, pa.int64())
                own = [b.column(c).take(take) for c in ("id", "label", "times")]
                yield pa.RecordBatch.from_arrays([*own[:2], pa.array(pos, pa.int32()), pa.array(prefix, pa.int64()), own[2], pa.array(before, pa.string()), pa.array(behind, pa.string())], schema=schema)

    return run


def _names(cells: np.ndarray) -> np.ndarray:
    """Dense numbers for the values of an array."""
    return np.unique(cells, return_inverse=True)[1].reshape(cells.shape)


def nodes_of(rows: list[tuple], least_offset: int = 0, most_offset: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """For each of the rows (group, before, behind, n, first occurrence) and each window around its start: how often the window
    occurs in the group, 0 where it isn't there or its offset is out of the range; and whether the row has the first occurrence of one that repeats.
    """
    number: dict[str, int] = {}
    width = LEFT + MIN_WORDS
    cells = -1 - np.arange(len(rows) * width, dtype=np.int64).reshape(len(rows), width)  # what is missing equals nothing
    whole = np.zeros((len(rows), WINDOW), bool)
    for i, (_, before, behind, _n, _f) in enumerate(rows):
        left = [number.setdefault(x, len(number)) for x in before.split(" ")] if before else []
        right = [number.setdefault(x, len(number)) for x in behind.split(" ")]
        cells[i, LEFT - len(left) : LEFT + len(right)] = left + right
        whole[i, LEFT - min(len(left), most_offset) : max(0, min(LEFT + len(right) - MIN_WORDS, LEFT - least_offset) + 1)] = True
    names, size = _names(cells), 1
    while size * 2 <= MIN_WORDS:
        names, size = _names(names[:, :-size] * (names.max() + 1) + names[:, size:]), size * 2
    rest = MIN_WORDS - size
    names = _names(names[:, :WINDOW] * (names.max() + 1) + names[:, rest : rest + WINDOW]) if rest else names[:, :WINDOW]
    group = _names(np.array([r[0] for r in rows], dtype=np.int64))
    node = _names((names * WINDOW + np.arange(WINDOW)) + group[:, None] * ((names.max() + 1) * WINDOW))
    count = np.bincount(node.ravel(), weights=np.repeat([r[3] for r in rows], WINDOW)).astype(np.int64)[node] * whole
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda i: rows[i][4])] = np.arange(len(rows))
    least = np.full(int(node.max()) + 1, len(rows), np.int64)
    np.minimum.at(least, node.ravel(), np.repeat(rank, WINDOW))
    return count, (least[node] == rank[:, None]) & (count > 1)


def _pieces(count: np.ndarray, leads: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    """(first window, one past the last, most copies, leads) of the runs of repeated windows of a row."""
    kinds = (count > 1).astype(np.int8) if leads is None else (count > 1).astype(np.int8) + leads
    cut = np.flatnonzero(np.diff(kinds)) + 1
    return [(a, b, int(count[a:b].max()), bool(kinds[a] == 2)) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kinds)]) if kinds[a]]


def _subtrees(kind: pa.DataType):
    """Reads suffixes in sorted order, equal ones as one, and gives the runs of all occurrences; groups are taken together up to GROUP_ROWS."""
    schema = pa.schema([("id", kind), *_RUN])
    zero = "" if kind == pa.string() else 0

    def runs_of(rows: list[tuple]) -> pa.RecordBatch:
        own = [(prefix, before, behind, sum(o[4] for o in seen), min(o[:4] for o in seen)) for prefix, behind, before, seen in rows]
        count, leads = nodes_of(own)
        out: list[tuple] = []
        for i, (*_, seen) in enumerate(rows):
            if (count[i] > 1).any():
                plain = _pieces(count[i], None)
                for o in seen:
                    void, key, label, pos, _ = o
                    parts = _pieces(count[i], leads[i]) if o[:4] == own[i][4] and leads[i].any() else plain
                    out.extend((None if void else key, label, pos - LEFT + a, pos - LEFT + b - 1, c, f) for a, b, c, f in parts)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for prefix, behind, before, key, label, pos, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "behind", "before", "id", "label", "pos", "n"))):
                same = (prefix, behind, before)
                if same != last:
                    if held >= GROUP_ROWS and prefix != last[0]:
                        yield runs_of(rows)
                        rows, held = [], 0
                    rows.append((*same, []))
                    last = same
                rows[-1][3].append((int(key is None), zero if key is None else key, label, pos, n))
                held += 1
        if rows:
            yield runs_of(rows)

    return run


def _large_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for different surroundings, each with its number and first occurrence, by ranges of offsets; gives runs of surroundings."""

    def nodes(rows: list[tuple], lo: int, hi: int) -> pa.RecordBatch:
        count, leads = nodes_of([r[2:] for r in rows], lo, hi)
        out = [(r[0], r[1], a, b, c, f) for i, r in enumerate(rows) if (count[i] > 1).any() for a, b, c, f in _pieces(count[i], leads[i])]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_NODE)], schema=_NODE)

    rows, now = [], None
    for batch in batches:
        for sid, sid2, group, lo, hi, before, behind, n, best in zip(*(batch.column(c).to_pylist() for c in ("sid", "sid2", "group", "lo", "hi", "before", "behind", "n", "best"))):
            if rows and ((lo, hi) != now or len(rows) >= GROUP_ROWS and group != rows[-1][2]):
                yield nodes(rows, *now)
                rows = []
            now = (lo, hi)
            rows.append((sid, sid2, group, before, behind, n, tuple((v is not None, v) if v is not None else (False,) for v in best.values())))
    if rows:
        yield nodes(rows, *now)


def _common(lo: F.Column, hi: F.Column) -> F.Column:
    """The words that all windows of offsets lo to hi around a start have in common, as an array."""
    left = F.when(F.col("before") == "", F.array().cast("array<string>")).otherwise(F.split("before", " "))
    return F.concat(F.slice(left, F.size(left) - lo + 1, lo), F.slice(F.split("behind", " "), F.lit(1), F.lit(MIN_WORDS) - hi))


def _longer(rows: DataFrame) -> DataFrame:
    """Each range of offsets in halves, where the surroundings are long enough for a window, grouped by what the half's windows share."""
    half = (F.col("hi") - F.col("lo") + 1) / 2
    halves = F.array(F.struct("lo", (F.col("lo") + half - 1).cast("int").alias("hi")), F.struct((F.col("lo") + half).cast("int").alias("lo"), "hi"))
    rows = rows.select("sid", "sid2", "before", "behind", "n", "best", F.explode(halves).alias("r")).select("sid", "sid2", "before", "behind", "n", "best", "r.lo", "r.hi")
    words = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    enough = (words("before") >= F.col("lo")) & (words("behind") >= F.lit(MIN_WORDS) - F.col("hi"))
    return rows.filter(enough).withColumn("group", F.xxhash64("lo", "hi", _common(F.col("lo"), F.col("hi"))))


def _runs_of_hot_prefixes(segments: DataFrame, s: Scratch) -> DataFrame:
    """(id, label, lo, hi, copies, first) for suffixes of prefixes that too many share."""
    key = ["prefix", "before", "behind"]
    named = segments.withColumns({"sid": F.xxhash64(*key), "sid2": F.xxhash64(F.lit(7), *key)})
    occurrence = F.struct(F.col("id").isNull().alias("void"), "id", "label", "pos")
    rows = named.groupBy("sid", "sid2", *key).agg(F.sum("n").alias("n"), F.min(occurrence).alias("best"))
    rows = s.table(rows.select("sid", "sid2", "before", "behind", "n", "best", F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"), F.col("prefix").alias("group")), "surroundings")
    firsts, found = rows.select("sid", "sid2", "best"), []
    width = WINDOW
    while True:
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).filter("total > 1")
        counted = s.table(rows.join(sizes.select("group", "rows"), "group"), "counted")
        fits = counted.filter(F.col("rows") <= GROUP_ROWS).repartition("group").sortWithinPartitions("lo", "group", "behind", "before")
        found.append(s.table(fits.select("sid", "sid2", "group", "lo", "hi", "before", "behind", "n", "best").mapInArrow(_large_subtrees, "sid bigint, sid2 bigint, lo int, hi int, copies bigint, leads boolean"), "nodes"))
        large = counted.filter(F.col("rows") > GROUP_ROWS)
        if large.isEmpty():
            break
        rows, width = _longer(large), width // 2
        if width == 1:  # groups of one window: nothing but the count and the first occurrence matters
            one = rows.withColumn("window", F.array_join(_common(F.col("lo"), F.col("hi")), " "))
            total = one.groupBy(F.col("lo").alias("o"), F.col("window").alias("w")).agg(F.sum("n").alias("copies"), F.min("best").alias("least")).filter("copies > 1")
            at = F.lit(LEFT) - F.col("lo")
            leaf = one.join(total, (F.col("lo") == F.col("o")) & (F.col("window") == F.col("w"))).select("sid", "sid2", at.alias("lo"), (at + 1).alias("hi"), "copies", F.col("best").eqNullSafe(F.col("least")).alias("leads"))
            found.append(s.table(leaf, "leaves"))
            break
        rows = s.table(rows, "longer")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.withColumnsRenamed({"lo": "a", "hi": "b"}).join(firsts, ["sid", "sid2"])
    start = F.col("pos") - LEFT
    return named.select("id", "label", "pos", "sid", "sid2").join(nodes.hint("merge"), ["sid", "sid2"]).select(
        "id", "label", (start + F.col("a")).cast("int").alias("lo"), (start + F.col("b") - 1).cast("int").alias("hi"), "copies", (F.col("leads") & occurrence.eqNullSafe(F.col("best"))).alias("first")
    )


def _merge(kind: pa.DataType):
    """Joins the runs of each document, which stand together, to passages."""
    schema = pa.schema([("doc_id", kind), *_SPAN])

    def passages(own: tuple, runs: list[tuple]) -> list[tuple]:
        size = max(r[1] for r in runs) + 1
        copies, later = np.zeros(size, np.int64), np.zeros(size, bool)
        for lo, hi, c, first in runs:
            copies[lo : hi + 1] = np.maximum(copies[lo : hi + 1], c)
            if not first:
                later[lo : hi + 1] = True
        out = []
        for first in (True, False):
            at = np.flatnonzero((copies > 0) & (later != first))
            if len(at):
                cut = np.flatnonzero(np.diff(at) > MIN_WORDS) + 1
                for part in np.split(at, cut):
                    out.append((own[0], int(part[0]), int(part[-1]) + MIN_WORDS, int(copies[part].max()), first))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, runs, out = None, [], []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "label", "lo", "hi", "copies", "first"))):
                if own is not None and r[:2] != own:
                    out += passages(own, runs)
                    runs = []
                    if len(out) >= 5000:
                        yield batch_of(out)
                        out = []
                own = r[:2]
                runs.append(r[2:])
        if runs:
            out += passages(own, runs)
        if out:
            yield batch_of(out)

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, copies, first): the passages made of 50-word windows that occur more than once.

    Words are what white space separates. Windows that are the first of their kind, by identifier and place, form passages
    of their own (first); all others are what deduplication removes. ``copies`` is the most occurrences of a
    window in the passage. Null, empty and shorter texts have none; null identifiers come last in the order, and identifiers may be of any type; repeated
    rows count, but are reported once; texts of any length are read whole. An empty table gives no rows. Only the two named columns are
    read, so others' names don't matter.
    """
    s = Scratch(docs.sparkSession, "repeats")
    name, kind = id_types(docs, key)
    own = identified(docs, key, text)
    found = s.table(anchors(own), "suffixes")
    shared = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("suffixes")).filter("suffixes > 1")
    marked = found.join(shared, "prefix").select("id", "label", F.struct("pos", "prefix", (F.col("suffixes") > GROUP_ROWS).alias("hot")).alias("start"))
    starts = marked.groupBy(F.col("id").alias("i"), F.col("label").alias("l")).agg(F.collect_set("start").alias("starts"), F.count(F.lit(1)).alias("n"))
    starts = s.table(starts.select("i", "l", "starts", (F.col("n") / F.size("starts")).cast("bigint").alias("times")), "starts")
    s.drop(found)
    state = starts.agg(F.max(F.exists("starts", lambda x: x["hot"])).alias("hot"), F.max("times").alias("times")).first()
    if (state.times or 0) > 1:
        own = own.dropDuplicates(["id", "label"])
    bring = lambda some: own.join(some, (own["label"] == some["l"]) & own["id"].eqNullSafe(some["i"])).select("id", "label", "times", "text", "starts").mapInArrow(_segments(kind), f"id {name}, label bigint, pos int, prefix bigint, n bigint, before string, behind string")
    part = lambda hot: starts.withColumn("starts", F.filter("starts", lambda x: x["hot"] == hot)).filter(F.size("starts") > 0)
    ordered = bring(part(False) if state.hot else starts).repartition("prefix").sortWithinPartitions("prefix", "behind", "before")
    runs = ordered.mapInArrow(_subtrees(kind), f"id {name}, label bigint, lo int, hi int, copies bigint, first boolean")
    if state.hot:
        runs = s.table(runs, "runs").unionByName(_runs_of_hot_prefixes(s.table(bring(part(True)), "hot"), s))
    return s.finish(runs.repartition("id", "label").sortWithinPartitions("id", "label").mapInArrow(_merge(kind), f"doc_id {name}, start_word int, end_word int, copies bigint, first boolean"))


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents),
w AS (SELECT doc_id, i - 1 AS i, array_to_string(t[i:i + {MIN_WORDS - 1}], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {MIN_WORDS - 2})) AS i FROM d WHERE len(t) >= {MIN_WORDS})),
c AS (SELECT g, count(*) AS n, min(doc_id) AS a FROM w GROUP BY g HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.i, c.n, w.doc_id = c.a AND w.i = min(CASE WHEN w.doc_id = c.a THEN w.i END) OVER (PARTITION BY w.g) AS first FROM w JOIN c USING (g)),
s AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, first ORDER BY i) + {MIN_WORDS} THEN 1 ELSE 0 END AS new FROM r),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {MIN_WORDS} AS INTEGER) AS end_word, max(n) AS copies, first FROM k GROUP BY doc_id, first, island
"""
