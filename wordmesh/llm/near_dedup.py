"""Operator 5: near-duplicates by bottom-k sketches of one hash function.

Each text's set of word 3-grams is hashed once and the k least values are kept. Values kept by one set only are of no
use; of the others, inverted lists are made. Two sets whose union sketch shows a similarity of ``floor`` share at least
``floor * k`` kept values, so it is enough that each set enters the lists of its rarest values but for the last
``floor * k - 1``: the lists of boilerplate that thousands of texts share stay nearly empty, and no pair that the union sketch
would pass is lost. Pairs from the lists are estimated on the union's sketch, then verified by exact Jaccard similarity.

The result is groups (connected components), so pairs inside a known group need not be compared. Some rounds compare
each list's members with one of them; what is verified joins groups; at last all pairs that still cross groups are
compared. So all that is left out are pairs that could not change the groups. A list that still has many members of
different groups then isn't paired off: its texts' full sets are listed by their rarest shingles, so many that two sets
of ``threshold`` must share one. That is exact too, and texts that share but a template have no rare shingle in common.

Copies are one node before anything is exploded, and how many nodes have a value is counted with partial sums, so a value
that a third of all texts share is no group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch, id_types, identified, slices
from wordmesh.llm.exact_dedup import keep_rows
from wordmesh.llm.graphs import components
from wordmesh.llm.words import gram_hashes, word_hashes

SHINGLE = 3
K = 64
THRESHOLD = 0.5
FLOOR = 0.35
ROUNDS = 3
#: Lists of up to so many nodes are compared pair by pair; longer ones go by the rarest shingles of full sets.
LIST_NODES = 500


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a text of fewer words is one shingle, one of no words has none."""
    h, count = word_hashes(texts)
    out, at = [], 0
    grams = gram_hashes(h, n)
    for c in count.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        else:
            out.append(gram_hashes(h[at : at + c], c)[:1] if c else np.zeros(0, np.uint64))
        at += c
    return out


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(id, label, node, n, sketch) of each row; node is a 64-bit digest of the whole set, null where there are no words."""
    name, kind = id_types(docs, key)
    schema = pa.schema([("id", kind), ("label", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = shingle_sets(b.column("text").to_pylist(), shingle)
                node = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), node, pa.array([len(s) for s in sets], pa.int32()), _lists([s[:k] for s in sets])], schema=schema)

    return identified(docs, key, text).mapInArrow(run, f"id {name}, label bigint, node bigint, n int, sketch array<bigint>")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(node, grams) of the nodes in ``wanted`` (node, id, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = _lists(shingle_sets(b.column("text").to_pylist(), shingle))
                yield pa.RecordBatch.from_arrays([b.column("node"), sets], names=["node", "grams"])

    own = identified(docs, key, text)
    wanted = wanted.select("node", F.col("id").alias("i"), F.col("label").alias("l"))
    found = own.join(wanted, (own["label"] == wanted["l"]) & own["id"].eqNullSafe(wanted["i"])).select("node", "text")
    return found.mapInArrow(run, "node bigint, grams array<bigint>").dropDuplicates(["node"])


def _ranked(values: DataFrame) -> DataFrame:
    """``values`` (v, node, n), each of a node once, with m, the values of the node that others have too, and their rank in it, the rarest first.

    Values of one node only are dropped. Two nodes that share ``need`` values share one of rank m - need + 1 or less in both.
    """
    df = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = W.partitionBy("node")
    return values.join(df, "v").withColumns({"m": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("df", "v"))})


def _within(need: F.Column) -> F.Column:
    return F.col("rank") <= F.col("m") - need + 1


def _crossing(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's nodes that are of different groups."""
    held = lists.join(labels, "node")
    other = held.select("v", F.col("node").alias("b"), F.col("label").alias("y"))
    return held.join(other, "v").filter("node < b and label <> y").select(F.col("node").alias("a"), "b")


def _by_rare_shingles(sets: DataFrame, labels: DataFrame, threshold: float, s: Scratch) -> DataFrame:
    """Pairs (a, b) of different groups, all of at least ``threshold`` among them, by the rarest shingles of full sets.

    Sets of na <= nb shingles as similar as that share threshold / (1 + threshold) * (na + nb), which is 2 * threshold /
    (1 + threshold) * na or more, and threshold * nb or more; so few of the smaller's shingles, and some more of the larger's, have to be listed.
    """
    values = sets.select("node", F.size("grams").alias("n"), F.explode("grams").alias("v"))
    listed = s.table(_ranked(values).filter(_within(F.ceil(F.col("n") * threshold - 1e-9))), "rare").join(labels, "node")
    small = listed.filter(_within(F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9)))
    large = listed.select("v", F.col("node").alias("b"), F.col("n").alias("k"), F.col("label").alias("y"))
    pairs = small.join(large, "v").filter((F.col("label") != F.col("y")) & (F.struct("n", "node") < F.struct("k", "b")) & (F.col("n") >= F.col("k") * threshold))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def _similar(pairs: DataFrame, sets: DataFrame, k: int, floor: float, threshold: float) -> DataFrame:
    """Of pairs (a, b) those of at least ``threshold``, with their Jaccard similarity."""
    side = lambda c, x, y: sets.select(F.col("node").alias(c), F.col(y).alias(x))
    est = pairs.join(side("a", "sa", "sketch"), "a").join(side("b", "sb", "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.array_intersect("sa", "sb")
    passed = est.withColumns({"u": union, "both": both}).filter(F.size(F.array_intersect("u", "both")) >= F.size("u") * floor).select("a", "b")
    full = passed.join(side("a", "ga", "grams"), "a").join(side("b", "gb", "grams"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    jaccard = common / (F.size("ga") + F.size("gb") - common)
    return full.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _relabel(labels: DataFrame, edges: DataFrame, s: Scratch) -> DataFrame:
    """Joins the groups that edges (a, b) between nodes connect."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    joined = components(edges.select("a", "b").join(la, "a").join(lb, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), s)
    joined = joined.select(F.col("node").alias("old"), F.col("label").alias("new"))
    return s.table(labels.join(joined, labels["label"] == joined["old"], "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE, threshold: float = THRESHOLD, floor: float = FLOOR, rounds: int = ROUNDS
) -> DataFrame:
    """(id, label, times, group_id, group_size, keep), a row for each distinct identifier and text.

    Rows are in one group if a chain of pairs of at least ``threshold`` links them; group_id is the least identifier,
    which stays (ties between texts of one identifier go by a hash). Texts of one set of shingles are one node, so copies are never
    compared with each other. Null and wordless texts are groups of their own; null identifiers come last and stay only where a group has
    no other. Very long texts are hashed whole, in slices. ``times`` counts repeated rows. An empty table gives no rows. Only the two
    named columns are read, so others' names don't matter.
    """
    s = Scratch(docs.sparkSession, "near")
    found = s.table(sketches(docs, key, text, k, shingle), "sketches")
    nodes = found.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "label")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = s.table(nodes.select("node", "r.id", "r.label", "n", "sketch"), "nodes")
    need = F.ceil(F.least(F.col("n"), F.lit(k)) * floor)
    lists = s.table(_ranked(nodes.select("node", "n", F.explode("sketch").alias("v"))).filter(_within(need)).select("v", "node"), "lists")
    listed = lists.select("node").distinct()
    cand = s.table(nodes.join(listed, "node", "left_semi").select("node", "id", "label", "sketch"), "candidates")
    s.drop(nodes)
    sets = s.table(cand.select("node", "sketch").join(_full_sets(docs, cand, key, text, shingle), "node"), "sets")
    s.drop(cand)
    labels = listed.select("node", F.col("node").alias("label"))
    for r in range(rounds + 1):
        held = lists.join(labels, "node")
        mixed = held.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("nodes"), F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(r))).alias("c"))
        mixed = mixed.filter("lo < hi")
        if r < rounds:
            star = held.join(mixed.select("v", "c"), "v").filter("label <> c.label")
            pairs = star.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
        else:
            left = s.table(lists.join(mixed.select("v", "nodes"), "v"), "crossing")
            pairs = _crossing(left.filter(F.col("nodes") <= LIST_NODES).select("v", "node"), labels)
            many = left.filter(F.col("nodes") > LIST_NODES).select("node").distinct()
            if not many.isEmpty():
                pairs = pairs.unionByName(_by_rare_shingles(sets.join(many, "node"), labels, threshold, s))
        edges = s.table(_similar(pairs.distinct(), sets, k, floor, threshold), "verified")
        if not edges.isEmpty():
            old, labels = labels, _relabel(labels, edges, s)
            s.drop(old)
        s.drop(edges)
    rows = found.groupBy("id", "label", "node").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(labels.select("node", F.col("label").alias("g")), "node", "left")
    rows = rows.withColumn("g", F.coalesce("g", "node"))
    best = rows.filter("g is not null").groupBy("g").agg(F.min_by(F.struct("id", "label"), F.struct(F.col("id").isNull(), "id", "label")).alias("best"), F.sum("times").alias("size"))
    keep = F.col("g").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("label") == F.col("best.label")))
    return s.finish(
        rows.join(best, "g", "left").select(
            "id", "label", "times", F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("group_id"), F.coalesce("size", "times").alias("group_size"), keep.alias("keep")
        )
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its group of near-duplicates, of size 1 for most."""
    return groups(docs, key, text).select(F.col("id").alias("doc_id"), "group_id", "group_size", "keep")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group and all their columns, whatever their names; rows without words all stay, repeated ones of them
    once. Ties, nulls, very long texts and an empty table as :func:`groups` says."""
    return keep_rows(docs, groups(docs, key, text).filter("keep"), key, text)


GROUPS_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < {SHINGLE} THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + {SHINGLE - 1}], ' ') END AS s
      FROM (SELECT doc_id, t, unnest(range(1, greatest(2, len(t) - {SHINGLE - 2}))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS group_id, count(*) AS group_size FROM r GROUP BY doc_id)
SELECT doc_id, group_id, group_size, doc_id = group_id AS keep FROM m
"""
