"""Small document tables with the awkward cases in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use, or once used, for columns of their own.
PRIVATE = "id label n part block name times row i l node sketch grams v g m df words hits spans clean language margin ambiguous slot at shard version h k piece keep bucket start end value kind".split()
WIDE = SCHEMA + ", node string, keep int, bucket string, label string, id string, times int, version string, slot string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def table(spark, texts, wide: bool = False, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) + (("x", 1, "b", "l", "i", 2, "v", "s") if wide else ()) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, WIDE if wide else SCHEMA)


AWKWARD = [None, "", "   ", "...", "a", "a", "Ünïcödé ß", "x" * 5000, " ".join(["lorem ipsum"] * 3000), "\U0001f600 emoji", "tab\tnew\nline\0nul"]


def awkward(spark, wide: bool = False):
    """Nulls in all columns, empty and long texts, ties and rows that repeat."""
    return table(spark, AWKWARD + AWKWARD, wide, [*range(len(AWKWARD)), *range(len(AWKWARD) - 2), None, None])


def with_private_names(spark, texts, upper: bool, string_ids: bool = False):
    """Documents with columns of the operators' own names, plain and behind underscores, each holding its own name."""
    from pyspark.sql import functions as F

    names = [x.upper() if upper else x for p in PRIVATE for x in (p, f"__{p}")]
    docs = table(spark, texts).select("doc_id", "text", "lang").withColumns({n: F.lit(n) for n in names})
    return docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))) if string_ids else docs


def keeps_private_values(out) -> bool:
    """Whether each of those columns still holds its own name in every row."""
    return all(r[n] == n for r in out.collect() for n in out.columns if n not in ("doc_id", "text", "lang"))
