"""Global ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.functions.storage import materialize


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with __rank, from 0 in the order of the columns, which must tell rows apart.

    Rows are sorted in ranges and written, so that the ranges are the same for both reads; a range's ranks start where the
    ranges before it end. Only one row a range is ordered in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    n = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")
    sizes = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))
    out = placed.withColumn("__n", n).join(F.broadcast(sizes), F.col("__part") == F.col("__p"))
    return out.withColumn("__rank", F.col("__before") + F.col("__n") - 1).drop("__part", "__p", "__n", "__before")
