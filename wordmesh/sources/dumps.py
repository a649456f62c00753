"""Gzipped dumps of JSON lines: the first line is a header, a blank line or one that starts with ] ends the records."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL = "https://en.wikipedia.org/wiki/"


def page_url(title: Column, prefix: str = URL) -> Column:
    """The address of a title, percent-escaped; null for null."""
    escaped = F.replace(F.replace(F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit(prefix), escaped)


def _packed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The text of a dump, and its files in the order of their names if all are compressed."""
    raw = spark.read.text(path)
    files = sorted(raw.inputFiles())
    return raw, files if all(f.endswith(".gz") for f in files) else []


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the records, in one scan. Lines are numbered in their order; a compressed file, which can't be split, is in one task.

    Compressed files come in the order of their names: a line's number has the file's place above bit 33 and the place in the file below.
    """
    raw, files = _packed(spark, path)
    if not files:
        return _lines_of_parts(raw)
    numbered = raw.select("value", F.input_file_name().alias("file"))
    plain = lambda f: unquote(f).replace("file:///", "file:/")
    place = {plain(f): i for i, f in enumerate(files)}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ended, start, n = None, False, 0, 0
        for b in batches:
            keep, line = [], []
            for i, (file, value) in enumerate(zip(b.column("file").to_pylist(), b.column("value").to_pylist())):
                if file != now:
                    now, ended, start, n = file, False, place[plain(file)] << 33, 0
                elif not ended:
                    ended = value.startswith("]") or not value.strip()
                    if not ended:
                        n += 1
                        keep.append(i)
                        line.append(start + n)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), b.column("value").take(pa.array(keep))], names=["line", "value"])

    return numbered.mapInArrow(body, "line bigint, value string")


def _lines_of_parts(raw: DataFrame) -> DataFrame:
    """The same for files that are read in parts: where a file starts and ends is found first."""
    raw = raw.select(F.monotonically_increasing_id().alias("line"), "value", F.input_file_name().alias("file"))
    start = raw.groupBy("file").agg(F.min("line").alias("start"))
    ends = F.trim(F.regexp_replace("value", r"\s", " ")) == ""
    body = raw.join(F.broadcast(start), "file").filter(F.col("line") > F.col("start"))
    stop = body.filter(ends | F.col("value").startswith("]")).groupBy("file").agg(F.min("line").alias("stop"))
    return body.join(F.broadcast(stop), "file", "left").filter(F.col("stop").isNull() | (F.col("line") < F.col("stop"))).select("line", "value")


def _window(found: DataFrame, skip: int, most: int, packed: bool) -> DataFrame:
    """The records from ``skip`` on, ``most`` at most, in the order of lines: counts of what each file or task holds say where its own records stand.

    Records of a compressed file are numbered as they stand, so none is moved; those of a task that read a part of a file are.
    """
    found = found.withColumn("__part", F.shiftright("line", 33))
    sizes = found.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")
    sizes = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))
    own = F.col("line").bitwiseAND(F.lit((1 << 33) - 1)) if packed else F.row_number().over(W.partitionBy("__part").orderBy("line"))
    out = found.join(F.broadcast(sizes), F.col("__part") == F.col("__p")).withColumn("__n", own + F.col("__before"))
    return out.filter((F.col("__n") > skip) & (F.col("__n") <= skip + most)).select("line", "value")


def _field(name: str) -> Column:
    """A top-level field as text: nested JSON as its text, true and false capitalized, null as ''."""
    v = F.try_variant_get(F.try_parse_json("value"), f"$['{name}']", "variant")
    kind = F.schema_of_variant(v)
    return F.when(F.is_variant_null(v), "").when(kind == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(v.cast("string"))


def read(spark: SparkSession, path: str, fields: list[str], skip: int = 0, take: int | None = None, count_all: bool = True, prefix: str = URL) -> DataFrame:
    """A column for each field, and line. ``skip`` leaves out the first records; ``take`` counts all records, or, with
    count_all false, those that have a wanted field; records without any are left out then. One scan serves all fields."""
    found = lines(spark, path)
    columns = {f: page_url(_field("title"), prefix) if f == "url" else _field(f) for f in fields}
    found = found.select("line", "value")
    if skip or (take is not None and count_all):
        found = _window(found, skip, take if take is not None and count_all else 2**62, bool(_packed(spark, path)[1]))
    out = found.select("line", *[c.alias(f) for f, c in columns.items()])
    if not count_all:
        plain = [f for f in fields if f != "url"]
        out = out.filter(F.coalesce(*[F.col(f) for f in plain]).isNotNull()) if plain else out.limit(0)
        if take is not None:
            out = out.orderBy("line").limit(take)
    return out


def pairs(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, line, value): a row for each field that a record has."""
    made = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in fields]))
    return records.select("line", F.explode(made).alias("p")).select("p.field", "line", "p.value")


class DataSource(Protocol):
    """Anything that gives (field, line, value) rows of the fields asked."""

    def get_data(self, fields: list[str]) -> DataFrame: ...


class DumpSource:
    """A gzipped dump as a source."""

    def __init__(self, spark: SparkSession, path: str, skip: int = 0, take: int | None = None):
        self.spark, self.path, self.skip, self.take = spark, path, skip, take

    def get_data(self, fields: list[str]) -> DataFrame:
        return pairs(read(self.spark, self.path, fields, self.skip, self.take), fields)


class TableSource:
    """The string columns of a table as a source; ``key`` numbers the rows."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key

    def get_data(self, fields: list[str]) -> DataFrame:
        return pairs(self.rows.select(F.col(self.key).alias("line"), *[F.col(f).cast("string").alias(f) for f in fields]), fields)


def table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table of a folder of tables."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}.parquet")
