from __future__ import annotations

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, awkward, keeps_private_values, table, with_private_names, words
from wordmesh.llm import packing, records, sharding, tokens

with open(tokens.VOCABULARY, "rb") as f:
    RAW = f.read()


def ids_of(text):
    return tokens._encoding(RAW).encode_ordinary(text) if text else []


def split_slow(n: int, most: int) -> list[int]:
    out = []
    while n >= 1 << most:
        out.append(most)
        n -= 1 << most
    for k in range(most - 1, -1, -1):
        if n & (1 << k):
            out.append(k)
    return out


def test_decompose():
    n = np.array([0, 1, 2, 3, 7, 8, 9, 100, 1000])
    powers, count = packing.decompose(n, 5)
    at = 0
    for x, c in zip(n.tolist(), count.tolist()):
        assert powers[at : at + c].tolist() == split_slow(x, 5)
        at += c
    assert at == len(powers)


def test_pieces_give_the_text_back(spark):
    rng = random.Random(1)
    texts = [words(rng, n) for n in (1, 3, 50, 400)] + AWKWARD
    got: dict = {}
    for r in packing.pack(table(spark, texts, wide=True), max_power=6).collect():
        assert r.length == 1 << r.bucket == len(r.tokens) and r.bucket <= 6
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        pieces = sorted(got.get(i, []), key=lambda r: r.piece)
        flat = [x for p in pieces for x in p.tokens]
        assert flat == ids_of(t) and tokens.decode(flat, RAW) == (t or "")
        assert [p.bucket for p in pieces] == split_slow(len(flat), 6)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]


def test_packing_awkward_rows_and_no_rows(spark):
    docs = awkward(spark, True)
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text)) for r in docs.collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_buckets_on_disk(spark, tmp_path):
    texts = [words(random.Random(k), 40 + k) for k in range(60)]
    pieces = packing.pack(table(spark, texts))
    back = packing.write_buckets(pieces, f"file://{tmp_path}/b", seed=3)
    assert back.schema.names == pieces.schema.names and sorted(map(tuple, back.collect())) == sorted(map(tuple, pieces.collect()))
    assert {int(os.path.basename(p).split("=")[1]) for p in glob.glob(f"{tmp_path}/b/bucket=*")} == {r.bucket for r in pieces.select("bucket").distinct().collect()}
    assert packing.write_buckets(pieces.limit(0), f"file://{tmp_path}/none").count() == 0


def test_large_buckets_are_many_files(spark, tmp_path):
    texts = [words(random.Random(k), 300) for k in range(400)]
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        packing.write_buckets(packing.pack(table(spark, texts).repartition(8)), f"file://{tmp_path}/b")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {int(p.split("=")[-1]): len(glob.glob(f"{p}/*.parquet")) for p in glob.glob(f"{tmp_path}/b/bucket=*")}
    assert files[max(files)] > 2 and files[0] < files[max(files)]


@pytest.mark.parametrize("upper", [True, False])
def test_private_names_and_string_identifiers(spark, tmp_path, upper):
    docs = with_private_names(spark, ["one two three", None, ""], upper, string_ids=True)
    pieces = packing.pack(docs).collect()
    assert {r.doc_id for r in pieces} == {"d000"} and tokens.decode([x for p in sorted(pieces, key=lambda r: r.piece) for x in p.tokens], RAW) == "one two three"
    index = records.write_records(docs, f"file://{tmp_path}/r")
    assert {r.doc_id: r.tokens for r in records.read_records(f"file://{tmp_path}/r", index).collect()} == {"d000": ids_of("one two three"), "d001": [], "d002": []}
    assert {r.doc_id: r.bytes for r in sharding.place(docs, 16, 4).collect()} == {"d000": 13, "d001": 0, "d002": 0}
    rows = sharding.assign(docs, sharding.initial_map(spark, 16, 4), n_slots=16).select("row.*")
    assert rows.columns == docs.columns and keeps_private_values(rows)


def crc_slow(raw: bytes) -> int:
    s = 0xFFFFFFFF
    for x in raw:
        s ^= x
        for _ in range(8):
            s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def test_checksums():
    assert crc_slow(b"123456789") == 0xE3069283
    parts = [os.urandom(n) for n in (4, 5, 63, 64, 65, 127, 128, 129, 1000, 5000)]
    assert records.crc32c(parts).tolist() == [crc_slow(p) for p in parts]
    assert records.crc32c([]).tolist() == []


def test_records_round_trip(spark, tmp_path):
    texts = [words(random.Random(3), n) for n in (1, 30, 3000)] + AWKWARD
    path = f"file://{tmp_path}/r"
    index = records.write_records(table(spark, texts, wide=True, ids=[*range(len(texts) - 2), None, -1]), path, file_bytes=2000)
    assert index.count() == len(texts) and index.select("file").distinct().count() > 1
    want = {i: ids_of(t) for i, t in zip([*range(len(texts) - 2), None, -1], texts)}
    for seed in (None, 5):
        assert {r.doc_id: r.tokens for r in records.read_records(path, index, seed).collect()} == want
    rows = index.collect()
    for r in rows:
        raw = open(f"{tmp_path}/r/data/{r.file}", "rb").read()[r.offset : r.offset + r.length]
        assert records.parse(records.unframe(raw)) == (r.doc_id, want[r.doc_id])
        broken = bytearray(raw)
        broken[len(raw) // 2] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    for name in {r.file for r in rows}:  # records fill their files without gaps
        own = sorted((r.offset, r.length) for r in rows if r.file == name)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == os.path.getsize(f"{tmp_path}/r/data/{name}")
    batches = list(records.shuffled_batches(rows, 1, 4))
    assert {r.doc_id for b in batches for r in b} == set(want) and max(map(len, batches)) == 4


def test_files_of_lost_attempts_go(spark, tmp_path):
    os.makedirs(tmp_path / "r/data")
    (tmp_path / "r/data/part-000000-lost").write_bytes(b"half a rec")
    index = records.write_records(awkward(spark), f"file://{tmp_path}/r")
    assert {os.path.basename(p) for p in glob.glob(f"{tmp_path}/r/data/*")} == {r.file for r in index.collect()}
    assert index.filter("doc_id is null").count() == 2
    assert records.record_index(awkward(spark).limit(0)).count() == 0


def test_payloads():
    for doc_id in (None, -1, 0, 2**62, "", "naïve"):
        for kind in ("<u2", "<u4"):
            assert records.parse(records.payload_of(doc_id, np.array([1, 65535], kind))) == (doc_id, [1, 65535])
            assert records.parse(records.payload_of(doc_id, np.zeros(0, kind))) == (doc_id, [])


def rebalance_slow(shard: dict, size: dict, tolerance: float, n: int) -> dict:
    total = sum(size.values())
    cap, mean = int(total * (1 + tolerance) / n // 1), total // n
    new, leaving, kept = dict(shard), [], {}
    for k in range(n):
        run = 0
        for s in sorted((s for s in shard if shard[s] == k), key=lambda s: (size.get(s, 0), s)):
            run += size.get(s, 0)
            if run > cap and size.get(s, 0):
                leaving.append(s)
            else:
                kept[k] = kept.get(k, 0) + size.get(s, 0)
    leaving += [s for s in shard if shard[s] >= n]
    rooms, hi = [], 0
    for k in range(n):
        room = max(0, mean - kept.get(k, 0))
        if room:
            rooms.append((hi, hi + room, k))
            hi += room
    out, at = sum(size.get(s, 0) for s in leaving), 0
    for s in sorted(leaving):
        mark = int(at / out * hi // 1) if out else -1
        new[s] = next((k for a, b, k in rooms if a <= mark < b), shard[s] if shard[s] < n else s % n)
        at += size.get(s, 0)
    return new


@pytest.mark.parametrize("n", [5, 6, 9, 4, 1])
def test_rebalancing(spark, tmp_path, n):
    """Onto as many shards as before, onto new ones, and onto fewer."""
    rng = random.Random(5)
    first = sharding.initial_map(spark, 256, 5)
    sizes = {s: rng.choice([0, 1, 5, 100]) * (3 if s % 5 == 2 else 1) for s in range(0, 256, 2)}
    second = sharding.rebalance(first, spark.createDataFrame(list(sizes.items()), "slot int, bytes bigint"), 0.05, n)
    before = {r.slot: r.shard for r in first.collect()}
    got = {r.slot: r.shard for r in second.collect()}
    assert got == rebalance_slow(before, sizes, 0.05, n) and got != before and max(got.values()) < n
    load = lambda k: sum(sizes.get(s, 0) for s in got if got[s] == k)
    assert max(map(load, range(n))) <= sum(sizes.values()) / n * 1.05 + max(sizes.values()) and all(load(k) > 0 for k in range(n))
    path = f"file://{tmp_path}/map"
    assert [sharding.save_version(first, path), sharding.save_version(second, path)] == [1, 2]
    assert {r.slot: r.shard for r in sharding.load_version(spark, path).collect()} == got
    assert {r.slot: r.shard for r in sharding.load_version(spark, path, 1).collect()} == before
    with pytest.raises(ValueError):
        sharding.save_version(second, path)
    with pytest.raises(ValueError):
        sharding.save_version(first.limit(0), path)
    assert sharding.load_version(spark, path, 7).count() == 0 and sharding.rebalance(first.limit(0), second.select("slot", F.lit(1).alias("bytes"))).count() == 0


def test_an_empty_shard_gets_slots(spark):
    """Shard 1 of 3 has no slot in the map."""
    first = spark.createDataFrame([(1, s, 0 if s < 3 else 2) for s in range(5)], "version int, slot int, shard int")
    got = sharding.rebalance(first, spark.createDataFrame([(s, 10) for s in range(5)], "slot int, bytes bigint"), n_shards=3).collect()
    assert {r.shard for r in got} == {0, 1, 2} and sorted(sum(r.shard == k for r in got) for k in range(3)) == [1, 2, 2]


def test_placing_edits_the_stored_map(spark, tmp_path):
    docs = table(spark, [words(random.Random(k), 5 + k % 40) for k in range(200)])
    path = f"file://{tmp_path}/map"
    sharding.save_version(sharding.initial_map(spark, 32, 4), path)
    one = sharding.place(docs, 32, 4, maps=path).collect()
    two = sharding.place(docs, 32, 5, maps=path).collect()
    assert {r.doc_id: r.shard_v2 for r in one} == {r.doc_id: r.shard_v1 for r in two} and max(r.shard_v2 for r in two) == 4
    stored = {r.slot: r.shard for r in sharding.load_version(spark, path, 3).collect()}
    assert all(stored[r.slot] == r.shard_v2 for r in two)


def test_placing(spark):
    docs = awkward(spark, True)
    got = sharding.place(docs, 16, 4)
    assert got.count() == docs.count() and got.filter("slot is null or shard_v2 is null").count() == 0
    assert got.filter("doc_id = 1").select("slot").distinct().count() == 1
    assert sharding.place(docs.limit(0), 16, 4).count() == 0
