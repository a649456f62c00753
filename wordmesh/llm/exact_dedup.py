"""Operator 4: exact deduplication by deterministic block naming.

Texts are cut into fixed-size byte blocks. Sorting all blocks gives each distinct one an integer name; then adjacent
names of a document are paired and the pairs sorted and named in the same way, level after level, until one name is
left. Two documents have equal names exactly if their texts are equal: no hash decides it. With k blocks in the
longest text there are ceil(log2 k) levels, each over the few documents of several blocks that are left.

Blocks are range-partitioned by their first bytes and a hash, so that the sample that ranges are made from is small, and
by document, so a block with millions of copies spreads over tasks; in a partition whole blocks are sorted and compared. A run of equal blocks may then cross partitions; what tasks report of their first and last block joins
such runs again. That report has two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch, col, id_types, identified, row_label, setting, with_rows

BLOCK_BYTES = 4096
HEAD_BYTES = 16
ARROW_ROWS = 1000
_RUN = [("label", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("run", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]


def _runs(kind: pa.DataType):
    """Numbers the runs of equal keys in a sorted partition; at the end a row with its first and last key."""
    schema = pa.schema([("id", kind), *_RUN])

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, run, first, last = TaskContext.get().partitionId(), -1, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("block")
            new = pc.not_equal(key[1:], key[:-1])
            opens = key[0].as_py() != last or run < 0
            at = pc.cumulative_sum(pa.concat_arrays([pa.array([run + opens], pa.int64()), pc.cast(new, pa.int64())]))
            run, last = at[-1].as_py(), key[-1].as_py()
            first = key[0].as_py() if first is None else first
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "n", "part")), pa.array([place] * b.num_rows, pa.int32()), at, none, none], schema=schema)
        if run >= 0:
            edge = [pa.nulls(1, f.type) for f in list(schema)[:4]]
            yield pa.RecordBatch.from_arrays([*edge, pa.array([place], pa.int32()), pa.array([run], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], schema=schema)

    return run_of


def _named(blocks: DataFrame, level: int, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, label, n, part, block) -> (id, label, n, part, name, times): equal blocks have equal names; and the table this reads."""
    spark = blocks.sparkSession
    names, kind = id_types(blocks, "id")
    head, rest = F.substring("block", 1, HEAD_BYTES), F.xxhash64("block")
    ordered = blocks.repartitionByRange(head, rest, "id", "label", "part").sortWithinPartitions(head, rest, "block")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        found = s.table(ordered.mapInArrow(_runs(kind), f"id {names}, label bigint, n bigint, part bigint, place int, run bigint, first binary, last binary"), f"names{level}")
    edges = found.filter(F.col("last").isNotNull())
    near = edges.select("place", "run", (F.col("first") == F.lag("last").over(W.orderBy("place"))).alias("goes_on"))
    remap, before = [], None
    for r in near.orderBy("place").collect():
        own = before if r.goes_on else (r.place, 0)
        if r.goes_on:
            remap.append((r.place, *own))
        before = own if r.run == 0 else (r.place, r.run)
    rows = found.filter(F.col("last").isNull())
    if remap:
        moved = spark.createDataFrame(remap, "place int, to_place int, to_run bigint").withColumn("run", F.lit(0).cast("bigint"))
        rows = rows.join(F.broadcast(moved), ["place", "run"], "left").withColumns({"place": F.coalesce("to_place", "place"), "run": F.coalesce("to_run", "run")})
    name = F.shiftleft(F.col("place").cast("bigint"), 40).bitwiseOR(F.col("run"))
    return rows.groupBy("id", "label", "n", "part").agg(F.max(name).alias("name"), F.count(F.lit(1)).alias("times")), found


def _wide(c: str) -> F.Column:
    return F.lpad(F.hex(F.col(c)), 16, "0")


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, label, blocks, name, times) for each distinct pair of identifier and text.

    Two rows of this have equal (blocks, name) exactly if their texts are equal. ``label`` tells different texts under
    one identifier apart, ``times`` counts repeated rows. Null texts are one identity (blocks = -1), empty ones
    another (blocks = 0); null identifiers are kept as they are. A very long text is only more blocks, which spread over tasks.
    An empty table gives no rows. Only the two named columns are read, so others' names don't matter.
    """
    s = Scratch(docs.sparkSession, "identities")
    own = identified(docs, key, text)
    raw = F.col("text").cast("binary")
    n = F.when(raw.isNull(), -1).otherwise(F.ceil(F.octet_length(raw) / F.lit(block_bytes))).cast("bigint")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.substring(F.coalesce(raw, F.lit(b"")), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = own.select("id", "label", n.alias("n"), F.posexplode(cut).alias("part", "block"))
    named, read = _named(blocks.withColumn("part", F.col("part").cast("bigint")), 0, s)
    named = s.table(named, "level0")
    s.drop(read)
    longest = named.agg(F.max("n")).first()[0] or 0
    done, rest, level = named.filter("n <= 1"), named.filter("n > 1").withColumn("size", F.col("n")), 0
    while longest > 1:
        level += 1
        half = F.floor(F.col("part") / 2)
        pairs = rest.groupBy("id", "label", "n", "size", half.alias("part")).agg(
            F.max(F.when(F.col("part") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("part") % 2 == 1, F.col("name"))).alias("b"), F.max("times").alias("times")
        )
        code = F.unhex(F.concat(_wide("a"), F.coalesce(_wide("b"), F.lit("F" * 16))))
        names, read = _named(pairs.select("id", "label", "n", "part", code.alias("block")), level, s)
        on = [pairs[c].eqNullSafe(names[c]) for c in ("id", "label", "part")]
        rest = s.table(
            pairs.join(names.drop("n", "times").hint("merge"), on).select(pairs.id, pairs.label, pairs.n, pairs.part, F.ceil(F.col("size") / 2).alias("size"), "name", pairs.times), f"level{level}"
        )
        s.drop(read)
        done, rest = done.unionByName(rest.filter("size <= 1").drop("size")), rest.filter("size > 1")
        longest = (longest + 1) // 2
    return s.finish(done.select("id", "label", F.col("n").alias("blocks"), "name", "times"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, label, canonical_id, n_copies, times, keep): the least identifier of equal texts stands for them.

    Names pack so well in files that the size of a file says little of the rows; so these joins are never broadcast.

    Null identifiers come last; a text of which all identifiers are null keeps one row. Ties between repeated rows are
    settled by :func:`deduplicate`, which keeps one of them. All else as :func:`identities` says.
    """
    own = identities(docs, key, text, block_bytes)
    groups = own.groupBy(F.col("blocks").alias("b"), F.col("name").alias("m")).agg(F.min("id").alias("canonical_id"), F.sum("times").alias("n_copies"))
    return own.join(groups.hint("merge"), (F.col("blocks") == F.col("b")) & (F.col("name") == F.col("m"))).select(
        "id", "label", "canonical_id", "n_copies", "times", F.col("id").eqNullSafe(F.col("canonical_id")).alias("keep")
    )


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document (a row for each distinct identifier and text) with the one that stands for its text."""
    return exact_groups(docs, key, text, block_bytes).select(F.col("id").alias("doc_id"), "canonical_id", "n_copies", "keep")


def keep_rows(docs: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` (id, label, times) names, each once, with all their columns."""
    own = with_rows(docs, i=col(key).cast(id_types(docs, key)[0]), l=row_label(text))
    found = own.join(kept.select("id", "label", "times"), (F.col("l") == F.col("label")) & F.col("i").eqNullSafe(F.col("id")))
    several = found.filter("times > 1").groupBy("i", "l").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return found.filter("times = 1").select("row").unionByName(several.select("row")).select("row.*")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row for each text and all their columns, whatever their names. Of repeated rows the first by their JSON form stays.

    Null texts are one text, empty ones another; very long ones are compared whole; of equal texts the least identifier stays (null ones
    last); an empty table stays empty.
    """
    return keep_rows(docs, exact_groups(docs, key, text, block_bytes).filter("keep"), key, text)


DUPLICATES_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id, count(*) OVER (PARTITION BY text) AS n_copies,
       doc_id = min(doc_id) OVER (PARTITION BY text) AS keep
FROM documents
"""
