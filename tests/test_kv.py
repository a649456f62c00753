from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from wordmesh.config import ColumnOptions
from wordmesh.operators import kv
from wordmesh.streaming.appends import put_stream


def rows(spark, data, kind="double"):
    return spark.createDataFrame([(k, s, v) for k, s, v in data], f"key {kind}, seq bigint, value binary")


def le(x: float) -> bytes:
    return struct.pack("<d", x)


@pytest.mark.parametrize("n", [1, 511, 512, 513])
def test_all_keys_can_be_read_back(spark, tmp_path, n):
    store = kv.ColumnStore(spark, f"file://{tmp_path}")
    data = rows(spark, [(float(i), i, le(i)) for i in range(n)])
    assert store.try_put("c", data) == n
    got = {r.key: bytes(r.value) for r in kv.get(store.read("c"), data.select("key")).collect()}
    assert got == {float(i): le(i) for i in range(n)}
    absent = kv.get(store.read("c"), spark.createDataFrame([(float(n),)], "key double")).first()
    assert bytes(absent.value) == b""


def test_page_full(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}", ColumnOptions(page_size=10))
    with pytest.raises(kv.PageFull):
        store.try_put("c", rows(spark, [(float(i), i, b"x") for i in range(11)]))
    assert store.try_put("c", rows(spark, [(float(i), i, b"x") for i in range(10)])) == 10


def test_duplicates_are_refused(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}")
    assert store.try_put("c", rows(spark, [(0.0, 0, b"a"), (0.0, 1, b"b")])) == 1
    assert store.try_put("c", rows(spark, [(0.0, 0, b"c"), (1.0, 1, b"d")])) == 1
    assert {(r.key, bytes(r.value)) for r in store.read("c").collect()} == {(0.0, b"a"), (1.0, b"d")}
    flags = kv.try_put_flags(store.read("c"), rows(spark, [(0.0, 0, b"e"), (7.0, 1, b"f"), (7.0, 2, b"g")])).collect()
    assert {(r.key, r.seq): r.inserted for r in flags} == {(0.0, 0): False, (7.0, 1): True, (7.0, 2): False}


def test_append_order(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}")
    store.try_put("c", rows(spark, [(2.0, 5, le(2))]))
    store.put_or_append("c", rows(spark, [(2.0, 0, le(3)), (2.0, 1, le(4)), (9.0, 0, le(1))]))
    got = kv.get_many(store.read("c"), spark.createDataFrame([(2.0,), (3.0,)], "key double")).collect()
    by = {r.key: (r.value and bytes(r.value), r["count"]) for r in got}
    assert by == {2.0: (le(2) + le(3) + le(4), 3), 3.0: (None, 0)}


def test_empty_values_are_refused(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}")
    for v in (b"", None):
        with pytest.raises(ValueError):
            store.try_put("c", rows(spark, [(0.0, 0, v)]))


def test_truncate_and_missing(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}")
    assert not store.truncate("c")
    with pytest.raises(FileNotFoundError):
        store.read("c")
    store.overwrite("c", rows(spark, [(0.0, 0, b"x")]))
    store.overwrite("other", rows(spark, [(0.0, 0, b"x")]))
    assert store.truncate("c") and not store.exists("c") and store.exists("other")


@pytest.mark.parametrize("kind,keys", [("double", [-2.5, -0.5, 0.0, 3.0]), ("float", [-1.5, 0.0, 2.0]), ("int", [-3, 0, 8]), ("bigint", [-(2**40), 0, 2**40]), ("string", ["a", "b", "ß"])])
def test_index_of(spark, kind, keys):
    column = rows(spark, [(k, i, b"v") for i, k in enumerate(keys)] * 2, kind)
    got = {r.key: r["index"] for r in kv.index_of(column, column.select("key").distinct()).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert {r.key: r["rank"] for r in kv.ranked_keys(column).collect()} == got
    assert [r.key for r in kv.sorted_keys(column).collect()] == sorted(keys)


def test_index_of_absent(spark):
    column = rows(spark, [(k, 0, b"v") for k in (10, 20, 30)], "int")
    got = {r.key: r["index"] for r in kv.index_of(column, spark.createDataFrame([(5,), (15,), (20,), (99,)], "key int")).collect()}
    assert got == {5: -1, 15: -2, 20: 1, 99: -4}


def test_sets(spark):
    a, b = rows(spark, [(1, 0, b"a"), (2, 0, b"b"), (2, 1, b"c")], "int"), rows(spark, [(2, 0, b"x"), (3, 0, b"y")], "int")
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(kv.union(a, b)) == [1, 2, 3] and keys(kv.intersect(a, b)) == [2] and keys(kv.difference(a, b)) == [1]
    r = kv.join(a, b).first()
    assert [bytes(x) for x in r.left_values] == [b"b", b"c"] and [bytes(x) for x in r.right_values] == [b"x"]


def test_page_append(spark):
    r = kv.page_append(rows(spark, [(1, 1, b"b"), (1, 0, b"a")], "int")).first()
    assert bytes(r.value) == b"ab"


def test_stream_of_puts(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    data = rows(spark, [(1, 0, b"a"), (2, 0, b"b"), (1, 1, b"c")], "int")
    data.write.parquet(source)
    store = kv.ColumnStore(spark, f"file://{tmp_path}/columns")
    for _ in range(2):
        put_stream(spark.readStream.schema(data.schema).parquet(source), store, "c", f"file://{tmp_path}/log", once=True).awaitTermination()
    assert sorted((r.key, bytes(r.value)) for r in store.read("c").collect()) == [(1, b"a"), (2, b"b")]
    assert store.read("c").select(F.countDistinct("key")).first()[0] == 2


def test_a_page_counts_the_keys_it_holds(spark, tmp_path):
    store = kv.ColumnStore(spark, f"file://{tmp_path}/paged", ColumnOptions(page_size=3))
    rows = lambda *keys: spark.createDataFrame([(k, i, b"v") for i, k in enumerate(keys)], "key bigint, seq bigint, value binary")
    assert store.try_put("c", rows(1, 2)) == 2
    with pytest.raises(kv.PageFull):
        store.try_put("c", rows(3, 4))
    assert store.try_put("c", rows(2, 3)) == 1
    store.put_or_append("c", rows(1, 3))
    with pytest.raises(kv.PageFull):
        store.put_or_append("c", rows(9))
    for size in (-1, 0x7FFFFFC8):
        with pytest.raises(ValueError):
            ColumnOptions(page_size=size)


def test_key_exists(spark):
    column = spark.createDataFrame([(1,), (1,), (None,)], "key bigint")
    got = {r.key: r.exists for r in kv.key_exists(column, spark.createDataFrame([(1,), (2,), (None,)], "key bigint")).collect()}
    assert got == {1: True, 2: False, None: False}
