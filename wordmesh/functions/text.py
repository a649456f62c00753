"""Splitting text into words by Unicode category."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmesh.functions.ranking import ranked

#: A math symbol alone, or a run of letters, numbers and symbols; all else, as all beyond the basic plane, separates.
WORDS = r"(\p{Sm}|[\p{L}\p{Nd}\p{Nl}\p{No}\p{Sc}\p{Sk}\p{So}&&[^\x{10000}-\x{10FFFF}]]+)"
#: The same for an engine without intersections of classes, on text whose characters beyond the basic plane were blanked.
SQL_BLANK = r"[\x{10000}-\x{10FFFF}]"
SQL_WORDS = r"\p{Sm}|[\p{L}\p{Nd}\p{Nl}\p{No}\p{Sc}\p{Sk}\p{So}]+"


def split_words(text: Column) -> Column:
    """array<string> of the words of a text; no case folding, no stop words. Null for null."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))


def tokens(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys..., pos, label): a row for each word."""
    return docs.select(*keys, F.posexplode(split_words(F.col(text))).alias("pos", "label"))


def is_math(label: Column) -> Column:
    return label.rlike(r"^\p{Sm}$")


def length_bucket(label: Column) -> Column:
    n = F.length(label)
    return F.when(n <= 4, F.concat(F.lit("len:"), n.cast("string"))).when(n <= 8, "len:5-8").when(n <= 16, "len:9-16").otherwise("len:17+")


def case_class(label: Column) -> Column:
    """lower or mixed, then upper and title where they hold, joined by +."""
    first = F.substring(label, 1, 1)
    parts = F.array(
        F.when(F.lower(label) == label, "lower").otherwise("mixed"),
        F.when(F.upper(F.replace(label, F.lit("\u00df"), F.lit(""))) == F.replace(label, F.lit("\u00df"), F.lit("")), "upper"),
        F.when(first.rlike(r"^\p{Lu}$"), "title"),
    )
    return F.concat_ws("+", F.array_compact(parts))


def vowel_pattern(label: Column) -> Column:
    """V for a vowel, C for another letter, X for the rest."""
    marked = F.regexp_replace(F.regexp_replace(label, r"[^\p{L}]", "\u0001"), "[aeiouyAEIOUY]", "\u0002")
    return F.translate(F.regexp_replace(marked, r"\p{L}", "C"), "\u0001\u0002", "XV")


def is_number(label: Column) -> Column:
    """Whether a word is a number; signs and points don't survive splitting."""
    return label.rlike(r"^[0-9]+([eE][0-9]+)?$") | F.lower(label).isin("infinity", "nan")


def unicode_range(docs: DataFrame, text: str = "text") -> DataFrame:
    """(first, least, most): the range of code units as documented (from 0), and the least one that occurs."""
    units = docs.select(F.explode(F.split(F.col(text), "")).alias("c")).filter("c <> ''").select(F.ascii("c").alias("u")).filter("u < 65536")
    return units.agg(F.lit(0).alias("first"), F.min("u").alias("least"), F.max("u").alias("most"))


def vocabulary(words: DataFrame, word: str, *order: str) -> DataFrame:
    """(word, index): the words by first appearance in ``order``, ties by the word."""
    first = words.groupBy(F.col(word).alias("word")).agg(F.min(_place(words, *order)).alias("at"))
    return ranked(first, "at", "word").select("word", F.col("__rank").cast("int").alias("index"))


def _place(rows: DataFrame, *order: str) -> Column:
    """A value in the order of the columns. For two integers, the second an int, it is one number: its least is found by hashing, that of structs by sorting all rows."""
    if [rows.schema[c].dataType for c in order] != [T.LongType(), T.IntegerType()]:
        return F.struct(*order)
    high, low = (F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(least).cast("decimal(20,0)")) for c, least in zip(order, ("-10000000000000000000", "-5000000000")))
    return high * F.lit("10000000000").cast("decimal(11,0)") + low


def vocabulary_tokens(sentences: DataFrame, words: DataFrame, sentence: str = "sentence", *keys: str) -> DataFrame:
    """(keys..., pos, word, index): words of sentences split at ';' that the vocabulary has. Spark broadcasts it where it is small."""
    parts = sentences.select(*keys, F.posexplode(F.filter(F.split(F.col(sentence), ";"), lambda w: w != "")).alias("pos", "word"))
    return parts.join(words, "word").select(*keys, "pos", "word", "index")


def word_counts(sentences: DataFrame, sentence: str = "sentence", *keys: str) -> DataFrame:
    """(keys..., word, n, pos): a row for each distinct word of each sentence split at ';', with its number and first place. Nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column("__sentence"), ";")
            words = lists.flatten()
            real = pc.not_equal(words, "")
            row, words = (x.filter(real) for x in (pc.list_parent_indices(lists), words))
            row, words = row.to_numpy().astype(np.int64), words.dictionary_encode()
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            code = words.indices.to_numpy().astype(np.int64)
            _, first, n = np.unique(row * max(len(words.dictionary), 1) + code, return_index=True, return_counts=True)
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), words.dictionary.take(pa.array(code[first])), pa.array(n.astype(np.int32)), pa.array(pos[first].astype(np.int32))], names=[*keys, "word", "n", "pos"])

    schema = T.StructType([sentences.schema[k] for k in keys] + [T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    return sentences.select(*keys, F.col(sentence).alias("__sentence")).mapInArrow(count, schema)
