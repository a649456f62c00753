"""Columns of unique keys with one or more byte values each, as Parquet tables.

A column's rows are (key, seq, value); a key's values are read in the order of seq. Keys may be of any atomic type.
What is written is never changed: a put adds files, so readers and retried tasks always see whole puts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.config import ColumnOptions
from wordmesh.functions.hashing import name_hash
from wordmesh.functions.ranking import ranked
from wordmesh.functions.storage import materialize


class PageFull(Exception):
    """A write has more distinct keys than a page holds."""


def first_of_key(rows: DataFrame) -> DataFrame:
    """The first row, by seq, of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("key").orderBy("seq", "value"))).filter("__n = 1").drop("__n")


def try_put(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of (key, seq, value) that are inserted: the first of each key that the column lacks."""
    return first_of_key(rows).join(existing.select("key").distinct(), "key", "left_anti").select("key", "seq", "value")


def try_put_flags(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, seq, inserted) for every row put."""
    old = existing.select("key").distinct().withColumn("__old", F.lit(True))
    rank = F.row_number().over(W.partitionBy("key").orderBy("seq", "value"))
    return rows.withColumn("__n", rank).join(old, "key", "left").select("key", "seq", (F.col("__old").isNull() & (F.col("__n") == 1)).alias("inserted"))


def put_or_append(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, values): each key's old values, then the new ones, in the order of seq."""
    both = existing.select("key", F.lit(0).alias("late"), "seq", "value").unionByName(rows.select("key", F.lit(1).alias("late"), "seq", "value"))
    packed = F.array_sort(F.collect_list(F.struct("late", "seq", "value")))
    return both.groupBy("key").agg(F.transform(packed, lambda x: x["value"]).alias("values"))


def page_append(rows: DataFrame) -> DataFrame:
    """(key, value): values of a key run together as one."""
    empty = rows.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("value")).limit(0)
    return put_or_append(empty, rows).select("key", _concat(F.col("values")).alias("value"))


def _concat(values: Column) -> Column:
    """Binary values run together."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.hex(v)), ""))


def grouped(column: DataFrame) -> DataFrame:
    return column.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("values"))


def get_many(column: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, count) for each key asked: all its values run together and their number; null and 0 where it is absent."""
    found = grouped(column.join(keys.select("key").distinct(), "key", "left_semi"))
    return keys.select("key").join(found, "key", "left").select("key", _concat(F.col("values")).alias("value"), F.coalesce(F.size("values"), F.lit(0)).alias("count"))


def get(column: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value): empty bytes where the key is absent."""
    return get_many(column, keys).select("key", F.coalesce("value", F.lit(b"")).alias("value"))


def key_exists(column: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, exists) for each key asked; a null key is in no column."""
    own = column.select("key").distinct().withColumn("__has", F.lit(True))
    return keys.select("key").join(own, "key", "left").select("key", F.coalesce("__has", F.lit(False)).alias("exists"))


def sorted_keys(column: DataFrame) -> DataFrame:
    return column.select("key").distinct().orderBy("key")


def ranked_keys(column: DataFrame) -> DataFrame:
    """(key, rank) over all distinct keys, in the order of keys."""
    return ranked(column.select("key").distinct(), "key").select("key", F.col("__rank").alias("rank"))


def index_of(column: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, index) of each probe: its rank, or the complement of where it would stand.

    Keys and probes are ordered together; a running count within ranges plus the counts of the ranges before gives ranks.
    """
    keys = column.select("key").distinct().withColumn("own", F.lit(1))
    both = keys.unionByName(probes.select("key").distinct().withColumn("own", F.lit(0)))
    both = both.repartitionByRange("key").sortWithinPartitions("key", "own").withColumn("part", F.spark_partition_id())
    both = materialize(both, "ranks")
    below = F.coalesce(F.sum("own").over(W.partitionBy("part").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    counted = both.withColumns({"upto": below, "has": F.max("own").over(W.partitionBy("part", "key"))})
    sizes = both.groupBy("part").agg(F.sum("own").alias("size"))
    sizes = sizes.select("part", (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    place = F.col("before") + F.col("upto")
    found = counted.filter("own = 0").join(F.broadcast(sizes), "part").select("key", F.when(F.col("has") == 1, place - 1).otherwise(-place - 1).alias("index"))
    return probes.select("key").join(found, "key")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").distinct().join(b.select("key").distinct(), "key", "left_anti")


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left_values, right_values) of the keys that both have."""
    return grouped(a).withColumnRenamed("values", "left_values").join(grouped(b).withColumnRenamed("values", "right_values"), "key")


class ColumnStore:
    """Columns below a folder, each named by the hash of its collection's name."""

    def __init__(self, spark: SparkSession, root: str, options: ColumnOptions = ColumnOptions()):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options

    def path(self, name: str) -> str:
        return f"{self.root}/{name_hash(name)}"

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def read(self, name: str) -> DataFrame:
        """The rows of a column; raises FileNotFoundError where there is none."""
        if not self.exists(name):
            raise FileNotFoundError(f"no column of the name {name}")
        return self.spark.read.parquet(self.path(name))

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        """Raises where a value is empty, or where the page has no room for the keys it holds and the new ones."""
        if not rows.filter("value is null or octet_length(value) = 0").isEmpty():
            raise ValueError("a value must not be empty")
        if self.options.page_size is not None:
            keys = rows.select("key").distinct()
            held = keys.union(self.read(name).select("key")).distinct() if self.exists(name) else keys
            if held.limit(self.options.page_size + 1).count() > self.options.page_size:
                raise PageFull(f"more than {self.options.page_size} keys in a page")
        return rows

    def _stored(self, name: str, like: DataFrame) -> DataFrame:
        return self.read(name) if self.exists(name) else self.spark.createDataFrame([], like.select("key", "seq", "value").schema)

    def try_put(self, name: str, rows: DataFrame) -> int:
        """Adds the rows of keys that the column lacks, and returns how many."""
        new = materialize(try_put(self._stored(name, rows), self._checked(name, rows)).sortWithinPartitions("key"), "put")
        new.write.mode("append").parquet(self.path(name))
        return new.count()

    def put_or_append(self, name: str, rows: DataFrame) -> None:
        """Adds all rows; those of known keys are numbered behind what is there."""
        old = self._stored(name, rows).groupBy("key").agg((F.max("seq") + 1).alias("after"))
        n = F.row_number().over(W.partitionBy("key").orderBy("seq", "value")) - 1
        new = self._checked(name, rows).withColumn("n", n).join(old, "key", "left").select("key", (F.coalesce("after", F.lit(0)) + F.col("n")).cast("bigint").alias("seq"), "value")
        materialize(new, "append").write.mode("append").parquet(self.path(name))

    def overwrite(self, name: str, rows: DataFrame) -> None:
        self._checked(name, rows).write.mode("overwrite").parquet(self.path(name))

    def truncate(self, name: str) -> bool:
        """Removes a column; false where there is none."""
        fs, path = self._fs(name)
        return bool(fs.delete(path, True))


