"""Exact search of sparse vectors: groups of queries meet groups of nodes, each pair of groups in one task.

A task multiplies blocks: its most shared words as dense matrices, all other words by their postings. These products are
approximate (single precision) and only say which pairs can be among the best; those are then scored exactly. Nothing
is left out, and a task holds two groups of bounded size, a block of products and the best so far. All pairs are
multiplied, so time grows with queries times nodes; what is shuffled is each side as often as the other has groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordmesh.config import GraphOptions

#: Entries of a group's vectors, at least and at most; rows of a block; words that go by matrices; pairs that are scored at once.
LEAST, MOST, BLOCK, HOT, AT_ONCE = 1 << 16, 1 << 22, 2048, 128, 1 << 14
SLACK = np.float32(1e-5)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Rows:
    """Sparse vectors as one run of entries."""

    def __init__(self, table: pa.Table):
        lists = [table[c].combine_chunks() for c in ("indices", "values")]
        self.n = table.num_rows
        self.word, self.value = (np.asarray(x.flatten(), dtype=t) for x, t in zip(lists, (np.int64, np.float64)))
        self.length = np.diff(np.asarray(lists[0].offsets)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.row = np.repeat(np.arange(self.n), self.length)
        self.squares = np.bincount(self.row, self.value * self.value, self.n)
        size = np.sqrt(self.squares)
        self.unit = (self.value / np.maximum(size, 1e-300)[self.row]).astype(np.float32)


class Products:
    """The products of two groups of rows."""

    def __init__(self, queries: Rows, nodes: Rows):
        self.q, self.n = queries, nodes
        self.words, self.n_word = np.unique(nodes.word, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, queries.word), max(len(self.words) - 1, 0))
        known = self.words[at] == queries.word if len(self.words) else np.zeros(len(at), bool)
        self.q_word, self.q_value, self.q_unit, self.q_row = at[known], queries.value[known], queries.unit[known], queries.row[known]
        self.q_start = np.searchsorted(self.q_row, np.arange(queries.n + 1))
        self.q_key = self.q_row * max(len(self.words), 1) + self.q_word
        shared = np.bincount(self.n_word, minlength=len(self.words)).astype(float) * np.bincount(self.q_word, minlength=len(self.words))
        hot = np.argsort(-shared, kind="stable")[:HOT]
        self.hot = np.full(len(self.words), -1)
        self.hot[hot] = np.arange(len(hot))

    def _split(self, word: np.ndarray, row: np.ndarray, unit: np.ndarray, count: int) -> tuple:
        at = self.hot[word]
        is_hot = at >= 0
        dense = np.zeros((count, HOT), np.float32)
        dense[row[is_hot], at[is_hot]] = unit[is_hot]
        cold = ~is_hot
        return dense, word[cold], row[cold], unit[cold]

    def nodes(self, a: int, b: int) -> tuple:
        """A block of nodes: its matrix and postings."""
        part = slice(self.n.start[a], self.n.start[b])
        dense, word, row, unit = self._split(self.n_word[part], self.n.row[part] - a, self.n.unit[part], b - a)
        order = np.argsort(word, kind="stable")
        return dense, word[order], row[order], unit[order]

    def block(self, qa: int, qb: int, nodes: tuple) -> np.ndarray:
        """Cosines of a block of queries with a block of nodes, in single precision."""
        part = slice(self.q_start[qa], self.q_start[qb])
        dense, word, row, unit = self._split(self.q_word[part], self.q_row[part] - qa, self.q_unit[part], qb - qa)
        n_dense, n_word, n_row, n_unit = nodes
        s = dense @ n_dense.T
        first, last = np.searchsorted(n_word, word, "left"), np.searchsorted(n_word, word, "right")
        for a in range(0, len(word), 4 * AT_ONCE):
            cut = slice(a, a + 4 * AT_ONCE)
            many = last[cut] - first[cut]
            at = np.repeat(first[cut], many) + ranges(many)
            np.add.at(s.reshape(-1), np.repeat(row[cut], many) * s.shape[1] + n_row[at], np.repeat(unit[cut], many) * n_unit[at])
        return s

    def dots(self, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Exact products of pairs of rows."""
        out = np.zeros(len(q))
        for a in range(0, len(q), AT_ONCE):
            qs, ns = q[a : a + AT_ONCE], n[a : a + AT_ONCE]
            many = self.n.length[ns]
            at = np.repeat(self.n.start[ns], many) + ranges(many)
            key = np.repeat(qs, many) * max(len(self.words), 1) + self.n_word[at]
            found = np.minimum(np.searchsorted(self.q_key, key), max(len(self.q_key) - 1, 0))
            if len(self.q_key):
                value = np.where(self.q_key[found] == key, self.q_value[found] * self.n.value[at], 0.0)
                out[a : a + AT_ONCE] = np.bincount(np.repeat(np.arange(len(qs)), many), value, len(qs))
        return out

    def best(self, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, node row, score) of the k best nodes of each query whose score is above 0; ties, to ``digits``, go to the earlier node.

        ``score`` gives the exact scores of pairs, at most what the product says; 0 takes a pair out.
        """
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held = {qa: none for qa in range(0, self.q.n, BLOCK)}
        least = np.zeros(self.q.n, np.float32)

        def keep(qa: int, q: np.ndarray, n: np.ndarray) -> None:
            found = score(q, n)
            ok = found > 0
            q, n, found = (np.concatenate([x, y[ok]]) for x, y in zip(held[qa], (q, n, found)))
            order = np.lexsort((n, -(found if digits is None else np.round(found, digits)), q))
            q, n, found = q[order], n[order], found[order]
            once = np.ones(len(q), bool)
            once[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
            q, n, found = q[once], n[once], found[once]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            held[qa] = tuple(x[place < k] for x in (q, n, found))
            full = place == k - 1
            least[q[full]] = found[full]

        for a in range(0, self.n.n, 2 * BLOCK):
            b = min(a + 2 * BLOCK, self.n.n)
            nodes = self.nodes(a, b)
            for qa in held:
                qb = min(qa + BLOCK, self.q.n)
                s = self.block(qa, qb, nodes)
                fresh = np.flatnonzero(least[qa:qb] == 0)
                likely = 2 * k + 14
                if len(fresh) and b - a > 2 * likely:  # a bound for queries that have none yet, from those that seem best
                    top = np.argpartition(s[fresh], b - a - likely, axis=1)[:, b - a - likely :]
                    keep(qa, np.repeat(fresh, likely) + qa, top.ravel() + a)
                at = np.flatnonzero(s > np.maximum(least[qa:qb] - SLACK, 0)[:, None])
                for c in range(0, len(at), 64 * AT_ONCE):
                    q, n = np.divmod(at[c : c + 64 * AT_ONCE], b - a)
                    keep(qa, q + qa, n + a)
        return tuple(np.concatenate(x) for x in zip(*held.values())) if held else none


def _grouped(nodes: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, keys: tuple[str, ...], together: tuple[str, ...]) -> DataFrame:
    """``run`` of each group of queries with each group of nodes; nodes of equal ``together`` are of one group."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = lambda df: df.agg(F.sum(F.size("indices") + 1)).first()[0] or 0
    nq, nn = entries(queries), entries(nodes)
    q_groups = 1 + nq // MOST
    n_groups = max(1 + nn // MOST, min(-(-parts // q_groups), 1 + nn // LEAST))
    cells = q_groups * n_groups
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("__q", F.pmod(F.xxhash64(*keys), F.lit(q_groups)).cast("int")).withColumn("__n", every(n_groups))
    n = nodes.withColumn("__n", F.pmod(F.xxhash64(*together), F.lit(n_groups)).cast("int")).withColumn("__q", every(q_groups))
    side = lambda df: df.withColumn("__cell", F.col("__q") * n_groups + F.col("__n")).drop("__q", "__n").repartition(3 * cells, "__cell").groupBy("__cell")
    none = to_arrow_schema(schema).empty_table()
    return side(q).cogroup(side(n)).applyInArrow(lambda asked, held: run(asked, held) if asked.num_rows and held.num_rows else none, schema)


def nearest(nodes: DataFrame, queries: DataFrame, *keys: str, k: int = 1) -> DataFrame:
    """(keys..., tree, node_id, preorder, score): the k best nodes of each query in each group of nodes, where the score is above 0. Values are counts."""
    schema = T.StructType([queries.schema[c] for c in keys] + [nodes.schema[c] for c in ("tree", "node_id", "preorder")] + [T.StructField("score", T.DoubleType())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("tree", "ascending"), ("preorder", "ascending")])
        p = Products(Rows(asked), Rows(held))
        size = np.sqrt(p.q.squares), np.sqrt(p.n.squares)

        def score(q: np.ndarray, n: np.ndarray) -> np.ndarray:
            by = size[0][q] * size[1][n]
            return np.divide(p.dots(q, n), by, out=np.zeros(len(q)), where=by > 0)

        q, n, found = p.best(k, score, 9)
        return pa.Table.from_arrays([*(asked[c].take(pa.array(q)) for c in keys), *(held[c].take(pa.array(n)) for c in ("tree", "node_id", "preorder")), pa.array(found, pa.float64())], names=schema.names)

    known = lambda df: df.filter(F.size("indices") > 0)
    return _grouped(known(nodes.select("tree", "node_id", "preorder", "indices", "values")), known(queries.select(*keys, "indices", "values")), run, schema, keys, ("tree", "node_id"))


def greedy(nodes: DataFrame, queries: DataFrame, *keys: str, options: GraphOptions = GraphOptions()) -> DataFrame:
    """(keys..., tree, node_id, score): in each group of trees, the best node that a query meets on its greedy ways down, where the score is above 0.

    A node is met if the scores of those above it lead there, so only nodes that can be the best are followed up to their roots. Scores have single
    precision, as the stored values have.
    """
    schema = T.StructType([queries.schema[c] for c in keys] + [nodes.schema[c] for c in ("tree", "node_id")] + [T.StructField("score", T.DoubleType())])
    fold, identical, precision = (np.float32(x) for x in (options.fold, options.identical, options.precision))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("tree", "ascending"), ("node_id", "ascending")])
        p = Products(Rows(asked), Rows(held))
        ids, lefts, rights = (np.asarray(held[c].combine_chunks()).astype(np.int64) for c in ("node_id", "left_id", "right_id"))
        root = np.maximum.accumulate(np.where(ids == 0, np.arange(len(ids)), 0)) if len(ids) else ids
        parent, is_left = np.full(len(ids), -1), np.zeros(len(ids), bool)
        for child, left in ((lefts, True), (rights, False)):
            has = np.flatnonzero(child >= 0)
            parent[root[has] + child[has]], is_left[root[has] + child[has]] = has, left
        size = np.sqrt(p.q.squares), np.sqrt(p.n.squares)

        def cosines(q: np.ndarray, n: np.ndarray) -> np.ndarray:
            by = (size[0][q] * size[1][n]).astype(np.float32)
            return np.divide(p.dots(q, n).astype(np.float32), by, out=np.zeros(len(q), np.float32), where=by > 0)

        def score(q: np.ndarray, n: np.ndarray) -> np.ndarray:
            out = cosines(q, n)
            live, at = np.flatnonzero(out > 0), n
            live = live[parent[at[live]] >= 0]
            now = at[live]
            while len(live):
                up = parent[now]
                s = np.where(ids[up] == 0, np.float32(0), cosines(q[live], up))
                left = s > fold
                ends = left & ((s >= identical) | (np.abs(s - identical) < precision))
                ok = np.where(is_left[now], left & ~ends, ~left)
                out[live[~ok]] = 0
                on = ok & (parent[up] >= 0)
                live, now = live[on], up[on]
            return out.astype(np.float64)

        q, n, found = p.best(1, score, None)
        return pa.Table.from_arrays([*(asked[c].take(pa.array(q)) for c in keys), *(held[c].take(pa.array(n)) for c in ("tree", "node_id")), pa.array(found, pa.float64())], names=schema.names)

    trees = nodes.select("tree", "node_id", "left_id", "right_id", "indices", "values")
    return _grouped(trees, queries.select(*keys, "indices", "values").filter(F.size("indices") > 0), run, schema, keys, ("tree",))
