"""Tables in the shared folder that the session names in spark.checkpoint.dir.

All that an application writes lies below one folder of it, so that :func:`sweep`, or an operator of the cluster, can
remove what an ended application left.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wordmesh-")
        atexit.register(shutil.rmtree, named[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/wordmesh/{spark.sparkContext.applicationId}"


_given: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application that was never given before."""
    _given.append(f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; frames that read from it can't be used after that."""
    remove(spark, own_dir(spark))


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for the jobs that run inside; what was there before is put back."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value).lower())
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back; what the job shuffled is removed when it has ended."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to this application's part of the shared folder and reads it back."""
    return write(df, new_path(df.sparkSession, name))


class Scratch:
    """The intermediate tables of one operator: each can be dropped when it is of no more use, and all are when its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root = spark, name, new_path(spark, name)
        self._held: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        out = write(df, path)
        self._held.append((out, path))
        return out

    def settle(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """Writes what ``make`` gives and removes the results of operators that were written on the way."""
        before = len(_given)
        out = self.table(make(), name)
        for path in _given[before:]:
            remove(self.spark, path)
        del _given[before:]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            for held in [x for x in self._held if x[0] is t]:
                remove(self.spark, held[1])
                self._held.remove(held)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the operator's result and removes all its other tables."""
        out = materialize(df, f"{self.name}-result")
        remove(self.spark, self.root)
        self._held.clear()
        return out
