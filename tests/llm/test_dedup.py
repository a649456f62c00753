from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, keeps_private_values, table, with_private_names, words
from wordmesh.llm import exact_dedup, graphs, near_dedup, substrings
from wordmesh.llm.common import Scratch
from wordmesh.llm.words import split


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_exact_groups_by_brute_force(spark, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(25)] + ["ababab" * 9, "abc", "abcabc", None, ""]
    texts = [rng.choice(base) for _ in range(60)]
    got = {r.doc_id: r for r in exact_dedup.duplicates(table(spark, texts), block_bytes=block).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {i: got[i].canonical_id for i in got} == {i: first[t] for i, t in enumerate(texts)}
    assert all(got[i].n_copies == texts.count(t) and got[i].keep == (first[t] == i) for i, t in enumerate(texts))


def test_runs_that_cross_partitions(spark):
    texts = ["same text"] * 300 + ["other"] * 100 + ["third one"]
    got = exact_dedup.duplicates(table(spark, texts).repartition(8), block_bytes=4).groupBy("canonical_id").count().collect()
    assert sorted((r.canonical_id, r["count"]) for r in got) == [(0, 300), (300, 100), (400, 1)]


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    docs = awkward(spark, True)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.text) for r in kept.collect()) == sorted({repr(r.text) for r in docs.collect()})
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    odd = table(spark, ["t", "u", "t", "u", "v"], ids=[1, 1, 1, None, None])  # one identifier for two texts, and none
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicate(odd).filter("doc_id is not null").collect()) == [(1, "t"), (1, "u")]
    assert exact_dedup.deduplicate(odd).count() == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


def shingle_sets(texts):
    sets, n = [], near_dedup.SHINGLE
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return sets


def near_slow(texts, least=near_dedup.THRESHOLD):
    sets = shingle_sets(texts)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def edited_texts(rng, sizes, copies=8, rate=0.04):
    out = []
    for size in sizes:
        base = words(rng, size).split()
        out += [" ".join(words(rng, 1) if rng.random() < rate else w for w in base) for _ in range(copies)]
    return out


def pairs_of(group):
    return {(i, j) for i in range(len(group)) for j in range(i) if group[i] == group[j]}


@pytest.mark.parametrize("longest", [500, 3])
def test_near_groups_by_brute_force(spark, monkeypatch, longest):
    """Sets of up to K shingles are their own sketches, so that no pair may be lost; with lists of 3 nodes the exact way is taken."""
    monkeypatch.setattr(near_dedup, "LIST_NODES", longest)
    rng = random.Random(8)
    texts = edited_texts(rng, (4, 12, 40, 60)) + edited_texts(rng, (30,), 20, 0.12)
    texts += [words(rng, 50) for _ in range(20)] + ["boiler plate line that many share"] * 3 + [words(rng, 30) + " boiler plate line that many share" for _ in range(15)]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].group_id for i in range(len(texts))] == near_slow(texts)
    assert all(got[i].keep == (got[i].group_id == i) for i in got)


def test_near_groups_of_long_texts(spark):
    """An estimate from 64 values is below the floor of 0.35 for a pair of 0.7 once in 10^8, so these may not be lost; nothing is joined wrongly."""
    rng = random.Random(9)
    texts = edited_texts(rng, (150, 300, 900), 10) + edited_texts(rng, (400,), 10, 0.1) + [words(rng, 80) for _ in range(20)]
    rng.shuffle(texts)
    have = pairs_of([r.group_id for r in sorted(near_dedup.near_duplicates(table(spark, texts)).collect())])
    assert pairs_of(near_slow(texts, 0.7)) <= have <= pairs_of(near_slow(texts))


@pytest.mark.parametrize("tail", [1, 12])
def test_a_value_that_thousands_of_different_texts_share(spark, monkeypatch, tail):
    """One shingle in all texts, short or long, of which none are similar but a few copies: no pairs of a list are compared."""
    monkeypatch.setattr(near_dedup, "LIST_NODES", 50)
    sizes = []
    similar = near_dedup._similar
    monkeypatch.setattr(near_dedup, "_similar", lambda pairs, *a: (sizes.append(pairs.count()), similar(pairs, *a))[1])
    rng = random.Random(10)
    texts = [f"see you there {' '.join(f'w{rng.randrange(10**9)}' for _ in range(tail))}" for _ in range(3000)]
    texts += [texts[5], texts[7] + " again"]
    got = near_dedup.near_duplicates(table(spark, texts)).filter("group_size > 1").collect()
    want = {5: 5, 3000: 5} | ({7: 7, 3001: 7} if tail > 1 else {7: 7, 3001: 7})
    assert {r.doc_id: r.group_id for r in got} == want
    assert sum(sizes) < 40 * len(texts)


@pytest.mark.parametrize("upper", [True, False])
def test_columns_of_private_names_and_string_identifiers(spark, upper):
    texts = ["one two three four", "one two three four", "five six seven eight nine", None, "", "one two three four"]
    docs = with_private_names(spark, texts, upper, string_ids=True)
    docs = docs.unionByName(docs)
    for out in (exact_dedup.deduplicate(docs), near_dedup.deduplicate(docs)):
        assert out.columns == docs.columns and keeps_private_values(out)
        assert sorted((r.doc_id, r.text) for r in out.filter("text <> ''").collect()) == [("d000", "one two three four"), ("d002", "five six seven eight nine")]


def test_near_dedup_awkward(spark):
    docs = awkward(spark, True)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [r.text for r in kept.collect()]
    assert got.count("a") == 1 and None in got and "" in got and got.count("\U0001f600 emoji") == 1
    assert len(got) == len(set((r.doc_id, r.text) for r in kept.collect()))
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def repeats_slow(texts, n=substrings.MIN_WORDS):
    w = [t.split() if t else [] for t in texts]
    at = defaultdict(list)
    for i, x in enumerate(w):
        for p in range(len(x) - n + 1):
            at[tuple(x[p : p + n])].append((i, p))
    out = []
    for i, x in enumerate(w):
        for first in (True, False):
            span = None
            for p in range(len(x) - n + 1):
                places = at[tuple(x[p : p + n])]
                if len(places) > 1 and (places[0] == (i, p)) == first:
                    if span and p <= span[1]:
                        span = [span[0], p + n, max(span[2], len(places))]
                    else:
                        if span:
                            out.append((i, *span, first))
                        span = [p, p + n, len(places)]
            if span:
                out.append((i, *span, first))
    return sorted(out)


@pytest.mark.parametrize("rows", [substrings.GROUP_ROWS, 40, 6, 1])
def test_repeats_by_brute_force(spark, monkeypatch, rows):
    """Also with groups so small that prefixes grow, up to whole windows."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", rows)
    rng = random.Random(11)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 120, 400)]
    texts = [" ".join([words(rng, rng.randint(0, 70)), rng.choice(passages), words(rng, rng.randint(0, 90)), rng.choice(passages)]) for _ in range(30)]
    texts += [" ".join(["tick tock boom"] * 60), " ".join(["tick tock boom"] * 50) + " end", words(rng, 300), "", None, words(rng, 49)]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.copies, r["first"]) for r in substrings.repeats(table(spark, texts, wide=True)).collect())
    assert got == repeats_slow(texts)


def test_no_task_holds_more_than_a_group(spark, monkeypatch):
    """One passage in thousands of documents, each with surroundings of its own: groups are of bounded size at every length of prefix."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", 50)
    rng = random.Random(13)
    passage = words(rng, 70)
    own = lambda n: " ".join(f"u{rng.randrange(10**12)}" for _ in range(n))
    texts = [f"{own(35)} {passage} {own(55)}" for _ in range(3000)]
    held, table_of = [], Scratch.table

    def spy(self, df, name):
        out = table_of(self, df, name)
        if name == "counted":
            held.append(out.filter(f"rows <= {substrings.GROUP_ROWS}").groupBy("group").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(Scratch, "table", spy)
    got = substrings.repeats(table(spark, texts)).collect()
    assert {(r.start_word, r.end_word, r.copies) for r in got} == {(35, 105, 3000)} and [r.doc_id for r in got if r["first"]] == [0] and len(got) == 3000
    assert len(held) == 5 and max(held) <= 50


@pytest.mark.parametrize("upper", [True, False])
def test_repeats_with_private_names_and_string_identifiers(spark, upper):
    text = words(random.Random(14), 60)
    got = sorted(map(tuple, substrings.repeats(with_private_names(spark, [text, words(random.Random(15), 60), text, None], upper, string_ids=True)).collect()))
    assert got == [("d000", 0, 60, 2, True), ("d002", 0, 60, 2, False)]


def test_repeats_awkward(spark):
    docs = awkward(spark)
    got = substrings.repeats(docs)
    assert {r.doc_id for r in got.collect()} == {8}
    assert substrings.repeats(docs.limit(0)).count() == 0
    twice = table(spark, [words(random.Random(1), 60)] * 2, ids=[None, 4])
    assert {(r.doc_id, r["first"]) for r in substrings.repeats(twice).collect()} == {(4, True), (None, False)}
    assert got.select(F.max("end_word")).first()[0] == 6000


def test_repeated_rows_are_first_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    void = sorted(map(tuple, substrings.repeats(table(spark, [text] * 40 + [text], ids=[None] * 40 + [3])).collect()), key=str)
    assert void == [(3, 0, 60, 41, True), (None, 0, 60, 41, False)]
    got = sorted(map(tuple, substrings.repeats(table(spark, [text, text, text], ids=[1, 1, 2])).collect()))
    assert got == [(1, 0, 60, 3, True), (2, 0, 60, 3, False)]
