"""Lexicons of word vectors keyed by angle: build, validate, probe for gaps, synthesize words that are in none."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.config import AnalyzerOptions
from wordmesh.functions import features, text, vectors
from wordmesh.functions.storage import materialize

#: Words that are looked up without a shuffle; bits of a document's number that stay in one run.
OFTEN, RUN = 20_000, 6


def keyed_labels(tokens: DataFrame, dims: int, *keep: str) -> DataFrame:
    """(label, keep..., vector, angle) of the distinct labels, or of rows of distinct labels with columns to keep:
    labels are featurized once, however often they occur."""
    return features.vectors(tokens, "label", dims, *keep).withColumn("angle", vectors.angle_key(F.col("vector")))


def build(docs: DataFrame, key: str = "doc_id", column: str = "text", options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """(angle, label, vector, doc_id, pos): for each angle the vector of the word that comes first, by document and place.

    Null and empty texts add nothing; an empty table gives an empty lexicon.
    """
    own = text.tokens(docs.select(F.col(key).alias("doc_id"), F.col(column).alias("text")), "text", "doc_id")
    first = own.groupBy("label").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    keyed = keyed_labels(first, options.dims, "at")
    best = keyed.groupBy("angle").agg(F.min_by(F.struct("label", "vector", "at"), F.struct("at", "label")).alias("b"))
    return best.select("angle", "b.label", "b.vector", F.col("b.at.doc_id").alias("doc_id"), F.col("b.at.pos").alias("pos"))


def save(lexicon: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a lexicon in the order of angles, so that files and row groups can be skipped by angle."""
    lexicon.repartitionByRange("angle").sortWithinPartitions("angle").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def known_words(docs: DataFrame, lexicon: DataFrame, column: str = "text", options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """(label, n, missing, mutual): each distinct word, how often it occurs, and its cosine with the vector stored under its angle."""
    words = text.tokens(docs.select(F.col(column).alias("text")), "text").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    stored = lexicon.select("angle", F.col("vector").alias("stored"))
    keyed = keyed_labels(words, options.dims, "n").join(stored, "angle", "left")
    mutual = F.when(F.col("stored").isNotNull(), vectors.sparse_cosine(F.col("vector"), F.col("stored")))
    return keyed.select("label", "n", F.col("stored").isNull().alias("missing"), mutual.alias("mutual"))


def lookups(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "text", options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """(doc_id, pos, label, missing, mutual): each word of each document against the vector stored under the word's angle.

    The OFTEN most frequent words are looked up where they are read; only the others are shuffled, so no word has a large part.
    """
    own = text.tokens(docs.select(F.col(key).alias("doc_id"), F.col(column).alias("text")), "text", "doc_id")
    known = materialize(known_words(docs, lexicon, column, options), "words")
    often = materialize(known.orderBy(F.col("n").desc(), "label").limit(OFTEN), "often").drop("n")
    near = own.join(F.broadcast(often), "label")
    far = own.join(F.broadcast(often.select("label")), "label", "left_anti").join(known.drop("n"), "label")
    return near.unionByName(far)


def validate_docs(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "text", options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """(doc_id, tokens, missing, collisions, lowest, lowest_label): a report for each document that has words.

    A collision is a stored vector of less than ``options.identity``; the lowest is the first least mutual cosine below
    1, and 1 with no label where there is none.
    """
    found = lookups(docs, lexicon, key, column, options)
    below = lambda c: F.min(F.when(F.col("mutual") < 1, c))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if("missing").alias("missing"), F.count_if(F.col("mutual") < options.identity).alias("collisions"),
        F.coalesce(below(F.col("mutual")), F.lit(1.0)).alias("lowest"), F.coalesce(below(F.struct("mutual", "pos", "label"))["label"], F.lit("")).alias("lowest_label"),
    )


@dataclass(frozen=True)
class Validation:
    valid: bool
    documents: int
    tokens: int
    missing: int
    collisions: int
    lowest: float
    lowest_label: str


def validate(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "text", options: AnalyzerOptions = AnalyzerOptions()) -> Validation:
    """Valid means that no word's angle is missing; collisions are counted and never fatal."""
    r = validate_docs(docs, lexicon, key, column, options).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum("missing").alias("m"), F.sum("collisions").alias("c"), F.min(F.struct("lowest", "doc_id", "lowest_label")).alias("low")
    )
    r = r.first()
    low = r.low
    return Validation(not r.m, r.n, r.t or 0, r.m or 0, r.c or 0, low.lowest if low else 1.0, low.lowest_label if low else "")


def missing_angles(lexicon: DataFrame, candidates: DataFrame) -> DataFrame:
    """The angles of ``candidates`` that the lexicon lacks."""
    return candidates.join(lexicon.select("angle").distinct(), "angle", "left_anti")


def sample_angles(spark: SparkSession, n: int, seed: int = 12345, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """n uniform angles in [lo, hi). Keys lie in (0, sqrt(10 / dims)], so the default range is mostly gap."""
    return spark.range(n, numPartitions=1).select((F.rand(seed) * (hi - lo) + lo).alias("angle"))


def synthesize(spark: SparkSession, n: int, seed: int = 12345) -> DataFrame:
    """(id, label): n made-up words of eight lower-case letters."""
    letters = [F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.rand(seed + k) * 26).cast("int") + 1, F.lit(1)) for k in range(8)]
    return spark.range(n, numPartitions=1).select("id", F.concat(*letters).alias("label"))


def compare(pairs: DataFrame, *keys: str, left: str = "left", right: str = "right", dims: int = 512) -> DataFrame:
    """(keys..., score): the cosine of the first word of left + right and the last; null where there is no word."""
    words = text.split_words(F.concat_ws(" ", F.col(left), F.col(right)))
    own = pairs.select(*keys, F.try_element_at(words, F.lit(1)).alias("a"), F.try_element_at(words, F.lit(-1)).alias("b"))
    known = features.vectors(own.select(F.explode(F.array("a", "b")).alias("label")), "label", dims)
    found = own.join(known.select(F.col("label").alias("a"), F.col("vector").alias("va")), "a", "left").join(known.select(F.col("label").alias("b"), F.col("vector").alias("vb")), "b", "left")
    return found.select(*keys, vectors.sparse_cosine(F.col("va"), F.col("vb")).alias("score"))


def compare_unit(docs: DataFrame, *keys: str, column: str = "text", dims: int = 512) -> DataFrame:
    """(keys..., score): the cosine of a text's first word with the unit vector."""
    own = docs.select(*keys, F.try_element_at(text.split_words(F.col(column)), F.lit(1)).alias("label"))
    known = features.vectors(own, "label", dims)
    return own.join(known, "label", "left").select(*keys, vectors.unit_cosine(F.col("vector")).alias("score"))


def neighbour_dots(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(a, b, dot): the product of the word counts of each document and of the next number's, where they share a word.

    Runs of RUN numbers are brought together, each with the number behind it, and read in their order: two documents' counts are held at a time.
    """
    own = docs.select(F.col(key).cast("bigint").alias("a"), F.col(column).alias("text")).filter("a is not null and text is not null")
    run = F.explode(F.array_distinct(F.array(F.shiftright("a", RUN), F.shiftright(F.col("a") - 1, RUN))))
    placed = own.select("a", run.alias("run"), "text").repartition("run").sortWithinPartitions("run", "a").select("run", "a", text.split_words(F.col("text")).alias("words"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, before = None, Counter(), None
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if before is not None and before[0] == (at[0], at[1] - 1):
                less, more = sorted((before[1], now), key=len)
                if dot := sum(n * more[w] for w, n in less.items() if w in more):
                    out.append((at[1] - 1, at[1], dot))

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["a", "b", "dot"])
            out.clear()
            return found

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for place, words in zip(zip(part.column("run").to_pylist(), part.column("a").to_pylist()), part.column("words")):
                    if place != at:
                        if at is not None:
                            close()
                            before = (at, now)
                        at, now = place, Counter()
                    now.update(words.as_py())
            yield rows()
        if at is not None:
            close()
            yield rows()

    return placed.mapInArrow(read, "a bigint, b bigint, dot bigint")


def document_vectors(docs: DataFrame, key: str = "doc_id", column: str = "text", dims: int = 512) -> DataFrame:
    """(key, idx, val): the normalized sum of each document's word vectors, in long form.

    A document's words are featurized and summed where it is read, so its entries aren't shuffled; only rows whose key others have, too, are brought together.
    """
    own = docs.select(key, text.split_words(F.col(column)).alias("words")).filter(F.size("words") > 0)
    often = docs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(key).alias("__key"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    single = own.join(often, same, "left_anti")
    several = own.join(often, same, "left_semi")
    kind = docs.schema[key].dataType
    long = f"key {kind.simpleString()}, idx int, val double"
    sums = features.sums(several.withColumnRenamed(key, "key"), dims, False, long).groupBy("key", "idx").agg(F.sum("val").alias("val"))
    size = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("key")))
    shared = sums.select("key", "idx", F.try_divide("val", size).alias("val"))
    return features.sums(single.withColumnRenamed(key, "key"), dims, True, long).unionByName(shared).withColumnRenamed("key", key)
