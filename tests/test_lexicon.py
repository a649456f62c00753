from __future__ import annotations

import gzip
import json

import pytest

from wordmesh import cli
from wordmesh.operators import lexicon
from wordmesh.sources import dumps

POEMS = ["an old silent pond\r\na frog jumps in", "“autumn” moonlight — a worm digs", "in the twilight rain\0 these brilliant hued", "§ 5 [lightning] flash …", "toward those short trees", None, ""]
UNKNOWN = ["xylophone quizzical", "zyzzyva", "flummoxed bumfuzzle"]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_build_and_validate(spark, tmp_path):
    docs = corpus(spark, POEMS)
    path = f"file://{tmp_path}/lexicon"
    lexicon.save(lexicon.build(docs), path)
    stored = lexicon.load(spark, path)
    assert stored.select("angle").distinct().count() == stored.count()
    good = lexicon.validate(docs, stored)
    assert good.valid and good.missing == 0 and good.documents == 5 and good.lowest <= 1.0
    bad = lexicon.validate(corpus(spark, UNKNOWN), stored)
    assert not bad.valid and bad.missing > 0


@pytest.mark.parametrize("often", [0, 2, 100])
def test_frequent_words_are_looked_up_as_others(spark, monkeypatch, often):
    monkeypatch.setattr(lexicon, "OFTEN", often)
    stored = lexicon.build(corpus(spark, ["a b c"])).localCheckpoint()
    found = lexicon.validate_docs(corpus(spark, ["a a x b", "y y x", "", None, "c"]), stored)
    got = sorted((r.doc_id, r.tokens, r.missing, r.collisions) for r in found.collect())
    assert got == [(0, 4, 1, 0), (1, 3, 3, 0), (4, 1, 0, 0)]
    shuffled = found.select("tokens", "missing", "lowest")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shuffled and "SortAggregate" not in shuffled


def test_neighbours_of_any_numbers_meet(spark):
    texts = [(-1, "a b"), (0, "a a c"), (63, "x y"), (64, "y y x"), (64, "y"), (65, "z"), (66, "z"), (68, "z"), (None, "z"), (69, None), (127, "q"), (128, "r")]
    frame = lexicon.neighbour_dots(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted(map(tuple, frame.collect())) == [(-1, 0, 2), (63, 64, 4), (65, 66, 1)]


def test_first_word_of_an_angle_stays(spark):
    r = {x.label: (x.doc_id, x.pos) for x in lexicon.build(corpus(spark, ["b a", "a c"])).collect()}
    assert r == {"b": (0, 0), "a": (0, 1), "c": (1, 1)}


def test_empty_corpus(spark):
    empty = lexicon.build(corpus(spark, POEMS).limit(0))
    assert empty.count() == 0
    v = lexicon.validate(corpus(spark, POEMS).limit(0), empty)
    assert v.valid and v.documents == 0 and v.lowest == 1.0 and v.lowest_label == ""


def test_gaps_and_made_up_words(spark):
    stored = lexicon.build(corpus(spark, POEMS))
    sampled = lexicon.sample_angles(spark, 32)
    assert all(-1 <= r.angle < 1 for r in sampled.collect())
    missing = lexicon.missing_angles(stored, sampled).count()
    made = lexicon.synthesize(spark, max(8, missing))
    labels = [r.label for r in made.collect()]
    assert len(labels) >= 8 and all(len(x) == 8 and x.isalpha() and x.islower() for x in labels)
    assert not lexicon.validate(made.selectExpr("id AS doc_id", "label AS text"), stored).valid
    assert lexicon.missing_angles(stored, stored.select("angle")).count() == 0


def write_dump(path, records, tail=("",)):
    with gzip.open(path, "wt") as f:
        f.write("[\n" + "\n".join(json.dumps(r) if not isinstance(r, str) else r for r in records) + "\n" + "\n".join(tail) + "\n")


RECORDS = [
    {"title": "A b*c~", "text": "one two", "n": 3, "ok": True, "none": None, "deep": {"x": [1]}},
    {"title": "B", "text": ""},
    {"other": 1},
    {"title": "C/d", "text": "three"},
]


def test_dump(spark, tmp_path):
    write_dump(tmp_path / "d.json.gz", RECORDS, ("]", json.dumps({"text": "behind the end"})))
    path = f"file://{tmp_path}/d.json.gz"
    got = dumps.read(spark, path, ["text", "url", "n", "ok", "none", "deep"]).orderBy("line").collect()
    assert [r.text for r in got] == ["one two", "", None, "three"]
    assert [r.url for r in got] == ["https://en.wikipedia.org/wiki/A%20b%2Ac~", "https://en.wikipedia.org/wiki/B", None, "https://en.wikipedia.org/wiki/C%2Fd"]
    assert (got[0].n, got[0].ok, got[0].none) == ("3", "True", "") and json.loads(got[0].deep) == {"x": [1]}
    assert [r.text for r in dumps.read(spark, path, ["text"], skip=1, take=2).orderBy("line").collect()] == ["", None]
    assert [r.text for r in dumps.read(spark, path, ["text"], take=3, count_all=False).orderBy("line").collect()] == ["one two", "", "three"]
    assert dumps.pairs(dumps.read(spark, path, ["text", "title"]), ["text", "title"]).count() == 6


def test_dump_ends_at_a_blank_line(spark, tmp_path):
    write_dump(tmp_path / "d.json.gz", [RECORDS[0], "", RECORDS[3]])
    assert dumps.read(spark, f"file://{tmp_path}/d.json.gz", ["text"]).count() == 1


def test_commands(spark, tmp_path, capsys):
    write_dump(tmp_path / "d.json.gz", [{"text": t} for t in POEMS if t])
    args = ["--dir", f"file://{tmp_path}/out", "--source", f"file://{tmp_path}/d.json.gz"]
    with pytest.raises(FileNotFoundError):
        cli.main(["validatelexicon", *args], spark)
    assert cli.main(["lexicon", *args, "--truncate", "--take", "4"], spark) == 0
    assert cli.main(["validatelexicon", *args, "--take", "4"], spark) == 0
    assert "valid True" in capsys.readouterr().out
    assert cli.main(["truncate", *args], spark) == 0
    assert cli.main(["stringcompare", "--string1", "abc", "--string2", "abd"], spark) == 0
    assert cli.main(["nothing"], spark) == 2


def test_arguments():
    assert cli.parse_args(["x", "--a", "1", "--flag", "--b", "2", "--last"]) == {"a": "1", "flag": "true", "b": "2", "last": "true"}
    with pytest.raises(ValueError):
        cli.parse_args(["x", "stray"])
