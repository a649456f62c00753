from __future__ import annotations

import gzip
import json

import pytest

from wordmesh.plans import registry
from wordmesh.sources import dumps


def written(folder, *files, packed=True):
    folder.mkdir()
    for k, lines in enumerate(files):
        with (gzip.open if packed else open)(folder / f"part-{k}{'.gz' if packed else '.json'}", "wt") as f:
            f.write("\n".join(lines) + "\n")
    return f"file://{folder}"


FILES = [["[", *[json.dumps({"title": f"t{k}{i}", "text": f"x{i}"} if i % 3 else {"title": f"t{k}{i}"}) for i in range(10)], "]", json.dumps({"title": "behind"})] for k in range(3)]
FILES[1].insert(6, "  ")


@pytest.mark.parametrize("packed", [True, False])
def test_files_start_and_end_on_their_own(spark, tmp_path, packed):
    path = written(tmp_path / "d", *FILES, packed=packed)
    got = {r.title for r in dumps.read(spark, path, ["title"]).collect()}
    assert got == {f"t{k}{i}" for k in range(3) for i in range(5 if k == 1 else 10)}


@pytest.mark.parametrize("packed", [True, False])
def test_windows_follow_the_lines(spark, tmp_path, packed):
    path = written(tmp_path / "d", *FILES, packed=packed)
    every = [r.title for r in dumps.read(spark, path, ["title"]).orderBy("line").collect()]
    for skip, take in ((0, 7), (4, 9), (20, None), (24, 50), (30, 1), (0, 0)):
        got = [r.title for r in dumps.read(spark, path, ["title"], skip=skip, take=take).orderBy("line").collect()]
        assert got == every[skip : None if take is None else skip + take]


def test_a_scan_of_packed_files_is_one(spark, tmp_path):
    plan = dumps.read(spark, written(tmp_path / "d", *FILES), ["title", "text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_packed_files_follow_their_names_whatever_their_sizes(spark, tmp_path):
    files = [["[", *[json.dumps({"title": f"t{k}-{i}", "text": "x" * (20 if k else 1)}) for i in range(n)]] for k, n in enumerate((3, 40, 0, 900, 5))]
    path = written(tmp_path / "d", *files)
    every = [f"t{k}-{i}" for k, n in enumerate((3, 40, 0, 900, 5)) for i in range(n)]
    assert [r.title for r in dumps.read(spark, path, ["title"]).orderBy("line").collect()] == every
    for skip, take in ((0, 5), (2, 50), (900, 100), (946, None)):
        window = dumps.read(spark, path, ["title"], skip=skip, take=take)
        assert [r.title for r in window.orderBy("line").collect()] == every[skip : None if take is None else skip + take]
    assert "hashpartitioning(__part" not in window.select("title")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_documents_are_dumped_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "DUMP_FILE", 1000)
    texts = {i: f"words \n ] of {i} " * 5 for i in range(60)} | {7: None}
    spark.createDataFrame(list(reversed(texts.items())), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(spark.read.text(registry._dump(spark, str(tmp_path))).inputFiles()) > 3
    assert {r.title: r.text for r in registry.dump_read(spark, str(tmp_path)).collect()} == {f"d{i}": t for i, t in texts.items() if t}
    lines = dumps.read(spark, registry._dump(spark, str(tmp_path)), ["title"], skip=5, take=20).orderBy("line").collect()
    assert [r.title for r in lines] == [f"d{i}" for i in range(60) if i != 7][5:25]


def test_sources_give_pairs(spark, tmp_path):
    dump = dumps.DumpSource(spark, written(tmp_path / "d", FILES[0]), take=4).get_data(["title", "text"])
    assert sorted((r.field, r.value) for r in dump.collect()) == [("text", "x1"), ("text", "x2"), *[("title", f"t0{i}") for i in range(4)]]
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3)], "n bigint, s string, i int")
    assert sorted(map(tuple, dumps.TableSource(rows, "n").get_data(["s", "i"]).collect())) == [("i", 2, "3"), ("s", 1, "a")]
