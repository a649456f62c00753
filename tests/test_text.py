from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordmesh.functions import features, hashing, text, vectors
from wordmesh.operators import lexicon

DATA = {"Lu", "Ll", "Nl", "Lm", "Lt", "Lo", "Sc", "Nd", "Sm", "Sk", "No", "So"}
ORDINAL = {c: i for i, c in enumerate("Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Zs Zl Zp Cc Cf Cs Co Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Cn".split())}


def split_slow(s: str) -> list[str]:
    out, word = [], ""
    for c in s + "\0":
        kind = unicodedata.category(c) if ord(c) < 0x10000 else "Cs"
        if kind in DATA and kind != "Sm":
            word += c
            continue
        if word:
            out.append(word)
            word = ""
        if kind == "Sm":
            out.append(c)
    return out


def feature_model(label: str, dims: int) -> dict[int, float]:
    """The features written down one by one, as an independent model."""
    u = hashing.units(label)
    h = lambda xs: hashing.fnv([ord(x) if isinstance(x, str) else x for x in xs]) % dims
    v: dict[int, float] = {}

    def bump(i: int, w: float) -> None:
        v[i] = v.get(i, 0.0) + w

    for i, c in enumerate(u[:dims]):
        v[i] = float(c)
    for n in (3, 4, 5):
        for i in range(len(u) - n + 1):
            bump(h(u[i : i + n]), 1.0)
    for i in range(len(u) - 1):
        bump((h("bg:") + h([u[i], u[i + 1], i & 255, i >> 8 & 255])) % dims, 0.75)
    for i in range(len(u) - 2):
        bump((h("sg1:") + h([u[i], u[i + 2], i & 255, i >> 8 & 255])) % dims, 0.5)
    if len(u) >= 3:
        start, end = u[:3], u[-3:]
    else:
        start, end = (u + [95, 95])[:3], ([95, 95] + u)[-3:]
    bump((h("tri:start:") + h(start)) % dims, 0.65)
    bump((h("tri:end:") + h(end)) % dims, 0.65)
    bump((h("first:") + h(u[:1])) % dims, 0.75)
    bump((h("last:") + h(u[-1:])) % dims, 0.75)
    n = len(u)
    bump(h(f"len:{n}" if n < 5 else "len:5-8" if n < 9 else "len:9-16" if n < 17 else "len:17+"), 0.5)
    bump((h("vc:") + h("".join(("V" if c.lower() in "aeiouy" else "C") if c.isalpha() else "X" for c in label))) % dims, 0.5)
    if n <= 3:
        bump(hashing.rolling(label) % dims, 0.8)
    bump(h("case:lower" if label.lower() == label else "case:mixed"), 0.5)
    if label.upper() == label:
        bump(h("case:upper"), 0.5)
    if unicodedata.category(label[0]) == "Lu":
        bump(h("case:title"), 0.5)
    for c in label:
        k = ORDINAL[unicodedata.category(c)]
        bump((h(f"{k % 10}{k // 10}") + h("uc:")) % dims, 0.25)
    bump((h("feat:number:") + h("is" if features.is_number(label) else "not")) % dims, 0.6)
    bump((h("feat:geo:") + h("is" if features.is_geo(label) else "not")) % dims, 0.6)
    size = math.sqrt(sum(x * x for x in v.values()))
    return {i: x / size for i, x in v.items() if x}


TEXTS = [
    "'\"?!.,;:()[]{}", "--- … — –", "don't stop", "a.b,c;d", "€money$ 5€", "Math≈Science", "A_b_c", "abc123", "1+2=3", "x≤y±z", "≈", "naïve café", "café x", "日本語 текст", "ab\U0001f600cd", "a\0b\r\nc",
    "“Quoted” §5", "", "  ", "½ Ⅻ ²", "^`¨", None,
]


def test_split_words_like_the_rules(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("id", text.split_words(F.col("text")).alias("w"))
    for r in rows.collect():
        assert r.w == (None if TEXTS[r.id] is None else split_slow(TEXTS[r.id])), TEXTS[r.id]


def test_hashes():
    assert hashing.name_hash("wikipedia") == 12661431104247448546
    assert hashing.fnv(b"") == hashing.OFFSET
    assert hashing.fnv_bytes(b"a") == 0xAF63DC4C8601EC8C - (1 << 64)


def test_fnv_columns(spark):
    words = ["", "a", "hello", "Ωmega", "€", "x" * 70]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for dims in (512, 500, 7):
        got = {r.w: r.b for r in rows.select("w", hashing.fnv_bucket(hashing.code_units(F.col("w")), dims).alias("b")).collect()}
        assert got == {w: hashing.bucket(w, dims) for w in words}


LABELS = ["a", "ab", "abc", "Hello", "WORLD", "123", "12e5", "≈", "€", "Straße", "éa", "x" * 40, "40N", "Nan", "infinity", "日本", "½", "x" * 300]


@pytest.mark.parametrize("dims", [16, 256, 512])
def test_features_equal_the_model(dims):
    for label, (i, v) in zip(LABELS, features.featurize(LABELS, dims)):
        want = feature_model(label, dims)
        assert i.tolist() == sorted(want)
        assert v.tolist() == pytest.approx([want[k] for k in sorted(want)], abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), min_size=1, max_size=12))
def test_features_have_unit_norm_and_do_not_depend_on_company(label):
    (i, v), _ = features.featurize([label, "other"])
    assert float((v * v).sum()) == pytest.approx(1.0)
    j, w = features.featurize([label])[0]
    assert i.tolist() == j.tolist() and v.tolist() == w.tolist()


def test_numbers_and_places():
    assert [features.is_number(x) for x in ("1", "1e5", "1,000", "-2.5", " 7 ", "NaN", "", "1x", "e5")] == [True, True, True, True, True, True, False, False, False]
    yes = ["40.7128,-74.0060", "34.0522 -118.2437", "51.5074N", "0.1278W", "40°42'51\"N", "74°00'21\"W", "404251°N", "45", "180"]
    no = ["hello", "Paris", "91N", "181E", "1000", "", "406051°N", "40°42", "NaN", "200,10"]
    assert all(map(features.is_geo, yes)) and not any(map(features.is_geo, no))


def document_cosine(spark, a: str, b: str, dims: int = 256) -> float:
    rows = spark.createDataFrame([(0, a), (1, b)], "doc_id int, text string")
    v: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for r in lexicon.document_vectors(rows, dims=dims).collect():
        v[r.doc_id][r.idx] = r.val
    assert sum(x * x for x in v[0].values()) == pytest.approx(1.0)
    return sum(x * v[1].get(i, 0.0) for i, x in v[0].items())


def test_similarity_of_numbers_and_places(spark):
    assert document_cosine(spark, "40.7128,-74.0060", "34.0522 -118.2437") > document_cosine(spark, "40.7128,-74.0060", "hello")
    assert document_cosine(spark, "51.5074N", "0.1278W") > document_cosine(spark, "51.5074N", "Paris")
    assert 0.1 < document_cosine(spark, "1", "1000000") < 0.99
    assert document_cosine(spark, "40°42'51\"N", "74°00'21\"W") > document_cosine(spark, "40°42'51\"N", "random")


def test_patterns_and_classes(spark):
    rows = spark.createDataFrame([("Hello",), ("abc1",), ("123",), ("ÉA",), ("x" * 17,)], "w string")
    got = rows.select("w", text.vowel_pattern(F.col("w")).alias("p"), text.case_class(F.col("w")).alias("c"), text.length_bucket(F.col("w")).alias("l")).collect()
    assert [tuple(r)[1:] for r in got[:3]] == [("CVCCV", "mixed+title", "len:5-8"), ("VCCX", "lower", "len:4"), ("XXX", "lower+upper", "len:3")]
    assert got[3].p == "CV" and got[4].l == "len:17+"


def test_unicode_range(spark):
    assert tuple(text.unicode_range(spark.createDataFrame([("bz",), ("é",), (None,)], "text string")).first()) == (0, 98, 233)


def test_codec():
    i, v = [3, 9], [0.5, -2.25]
    assert vectors.decode(vectors.encode(i, v)) == (i, v) and vectors.decode(vectors.encode(i, v, "f"), "f") == (i, v)
    assert vectors.encode([], []) == b"\0\0\0\0"
    with pytest.raises(ValueError):
        vectors.decode(vectors.encode(i, v), "f")
    with pytest.raises(ValueError):
        vectors.encode(i, v[:1])


def test_zero_vectors_have_no_score(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = r.select(vectors.cosine(a, b).alias("c"), vectors.signature(a, b).alias("s")).first()
    assert got.c is None and got.s.cosine == 0.0 and got.s.projection == 0.0 and got.s.jaccard == 0.0


def test_document_vectors_sum_words_where_they_are(spark):
    """Rows of one key are one document, also of no key; empty ones have no vector."""
    texts = [(1, "alpha beta alpha"), (2, "gamma"), (2, "gamma delta é"), (None, "one"), (None, "two"), (3, "..."), (4, None)]
    got: dict = {}
    frame = lexicon.document_vectors(spark.createDataFrame(texts, "doc_id bigint, text string"))
    for r in frame.collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.val
    want = {1: ["alpha", "beta", "alpha"], 2: ["gamma", "gamma", "delta", "é"], None: ["one", "two"]}
    assert set(got) == set(want)
    for key, words in want.items():
        total = np.zeros(512)
        for i, v in features.featurize(words):
            total[i] += v
        assert got[key] == pytest.approx({i: x for i, x in enumerate(total / np.sqrt((total * total).sum())) if x})
    single = lexicon.document_vectors(spark.createDataFrame([(i, f"w{i} x") for i in range(600)], "doc_id bigint, text string"))
    assert single.select("doc_id").distinct().count() == 600


def test_rounding_keeps_the_sign_of_zero(spark):
    r = spark.createDataFrame([(x,) for x in (-4e-7, 4e-7, -0.1234565, 0.0, None, float("nan"))], "v double").select(vectors.rounded(F.col("v"), 6).alias("r")).collect()
    assert [str(x.r) for x in r] == ["-0.0", "0.0", "-0.123457", "0.0", "None", "nan"]


def test_angle_key_is_the_signature_in_long_form(spark):
    labels = ["hello", "Paris", "123"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r.k for r in features.vectors(rows).select("label", vectors.angle_key(F.col("vector")).alias("k")).collect()}
    for label, (i, v) in zip(labels, features.featurize(labels)):
        full, u = [0.0] * 512, 1 / math.sqrt(512)
        for k, x in zip(i.tolist(), v.tolist()):
            full[k] = x
        d = sum(full) * u
        sig = [d, math.acos(d), d, 1.0, 1.0, math.sqrt(sum((x - u) ** 2 for x in full)), sum(abs(x - u) for x in full), d, len(i), len(i) / 512]
        assert got[label] == pytest.approx(sum(sig) * u / math.sqrt(sum(s * s for s in sig)), abs=1e-12)
        assert 0 < got[label] <= math.sqrt(10 / 512)


def test_as_text(spark):
    r = spark.createDataFrame([([104.0, 105.4, 8364.0],)], "v array<double>").select(features.as_text(F.col("v")).alias("t")).first()
    assert r.t == "hi€"


def test_compare(spark):
    rows = spark.createDataFrame([(0, "alpha beta", "gamma alpha"), (1, "", "")], "id int, left string, right string")
    got = {r.id: r.score for r in lexicon.compare(rows, "id").collect()}
    assert got[0] == pytest.approx(1.0) and got[1] is None
    unit = {r.id: r.score for r in lexicon.compare_unit(rows, "id", column="left").collect()}
    i, v = features.featurize(["alpha"])[0]
    assert unit[0] == pytest.approx(v.sum() / math.sqrt(512)) and unit[1] is None


def test_vocabulary(spark):
    words = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "pos int, w string")
    v = text.vocabulary(words, "w", "pos")
    assert {r.word: r["index"] for r in v.collect()} == {"b": 0, "a": 1, "c": 2}
    s = spark.createDataFrame([(0, "a;;b;z;a")], "id int, sentence string")
    assert sorted((r.pos, r.word) for r in text.vocabulary_tokens(s, v, "sentence", "id").collect()) == [(0, "a"), (1, "b"), (3, "a")]
    assert re.match(r"\w", "a")


def test_words_are_counted_where_they_are_read(spark):
    s = spark.createDataFrame([(7, "b;a;;b"), (7, "a"), (8, None), (9, ";")], "id bigint, sentence string")
    counts = text.word_counts(s, "sentence", "id")
    assert sorted(map(tuple, counts.collect())) == [(7, "a", 1, 0), (7, "a", 1, 1), (7, "b", 2, 0)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_first_places_are_found_without_sorting(spark):
    rows = [("z", 3, 0), ("a", 3, 1), ("z", 2, 9), ("m", -5, 3), ("n", -5, 2), ("o", -(2**63), 4), ("p", 2**63 - 1, 2**31 - 1), ("q", 2**63 - 1, 0), ("r", None, 1), ("s", None, None), ("t", 2, 9), ("a", 1, 5)]
    words = spark.createDataFrame(rows, "w string, id bigint, pos int")
    low = lambda x: float("-inf") if x is None else x
    first = {w: min((low(i), low(p)) for x, i, p in rows if x == w) for w, _, _ in rows}
    want = {w: n for n, w in enumerate(sorted(first, key=lambda w: (*first[w], w)))}
    assert {r.word: r["index"] for r in text.vocabulary(words, "w", "id", "pos").collect()} == want
    plan = words.groupBy("w").agg(F.min(text._place(words, "id", "pos")))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
