from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.helpers import awkward, table, words
from wordmesh.llm import near_dedup, tokens
from wordmesh.llm.common import materialize
from wordmesh.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rng = random.Random(2)
    item = words(rng, 20)
    clean = [words(rng, rng.randint(20, 80)) for _ in range(20)]
    near = clean[0].split()
    near[3] = "changed"
    docs = table(spark, [*clean, clean[1], clean[2], " ".join(near), f"{words(rng, 50)} {item} {words(rng, 5)}", item, None, ""], wide=True)
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = materialize(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert {i: texts.get(i) for i in range(20)} == dict(enumerate(clean))
    assert set(texts) == {*range(20), 23} and item not in texts[23]
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    with open(tokens.VOCABULARY, "rb") as f:
        raw = f.read()
    for i, t in texts.items():
        assert tokens.decode([x for p in sorted((p for p in packed if p.doc_id == i), key=lambda p: p.piece) for x in p.tokens], raw) == t


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("some", awkward(spark, True)), ("none", awkward(spark).limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "one two")], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "piece", "start", "bucket", "length", "tokens"] and (got.count() > 0) == (name == "some")
    assert near_dedup.THRESHOLD == 0.5
