"""Helpers shared by the operators of this subpackage: staged tables, joins that hold up under hot keys, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column table of ids (at most about 30 MB) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor depend on an executor.

    ``rows``: how many a row group holds at most, for tables whose rows are megabytes: writers and readers hold whole row groups,
    and by itself the format looks at a group's size only after a hundred rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write if rows is None else df.write.option("parquet.block.row.count.limit", rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches, then ``give_back``: Python workers live on through later stages, and so would what they once held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def lookup(rows: DataFrame, table: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per ``key``), whatever number of rows share a key.

    A table of at most ``limit`` rows is broadcast. Beyond that, keys that hold over a thousandth of the rows
    (so at most 1,000 of them) are answered by broadcasting their own few table rows, and all others by a shuffle.
    """
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = stage(counts.where(F.col("_n") > max(10_000, total // 1000)).select(key), "hot")
    if not hot.take(1):
        return rows.join(table, key, "left")
    hot_table = stage(table.join(F.broadcast(hot), key, "left_semi"), "hot-rows")
    heated = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_table), key, "left")
    return heated.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, comp) for each node of an edge, comp the smallest id reachable.

    Each round hooks every node to its smallest neighbour, jumps the pointers once and contracts the edges, so that the
    number of nodes left falls geometrically; edges never gather by component in one task. No edge: an empty table.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "parents")
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        parent = stage(lookup(parent, up, "up", limit).select("node", F.coalesce("upper", "up").alias("up")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("comp"))
        else:
            move = parent.select(F.col("node").alias("comp"), "up")
            labels = stage(lookup(labels, move, "comp", limit).select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            move = parent.select(F.col("node").alias(end), "up")
            edges = lookup(edges, move, end, limit).withColumn(end, F.coalesce("up", end)).drop("up")
        edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
