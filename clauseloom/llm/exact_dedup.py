"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, stage

RUN = "slot long, digest binary, n_bytes long, proof long, keep_id long, group_size long"


def _merge(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Fold neighbours of a sorted stream that agree in slot, digest, length and second hash; keeps one row between batches."""
    pick = np.maximum if largest else np.minimum
    last = None
    for batch in batches:
        table = pa.Table.from_batches(([last] if last is not None else []) + [batch])
        if not table.num_rows:
            continue
        batch = table.combine_chunks().to_batches()[0]
        digest = np.frombuffer(b"".join(batch["digest"].to_pylist()), dtype="S32")
        slot, size, proof, ids, count = (batch[k].to_numpy(zero_copy_only=False) for k in ("slot", "n_bytes", "proof", "keep_id", "group_size"))
        new = np.ones(len(slot), bool)
        raw = digest.view("u8").reshape(-1, 4)
        new[1:] = (raw[1:] != raw[:-1]).any(1) | (slot[1:] != slot[:-1]) | (size[1:] != size[:-1]) | (proof[1:] != proof[:-1])
        at = np.flatnonzero(new)
        out = batch.take(pa.array(at))
        out = pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(pick.reduceat(ids, at), pa.int64()), pa.array(np.add.reduceat(count, at), pa.int64())], schema=batch.schema)
        yield out.slice(0, out.num_rows - 1)
        last = out.slice(out.num_rows - 1)
    if last is not None:
        yield last


def _digit(value: Column, ways: int, level: int) -> Column:
    return F.pmod(F.floor(value / F.lit(float(ways**level))).cast("long"), F.lit(ways))


def digests(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digest, n_bytes, proof): SHA-256 with length and a second hash, by which equal digests are verified."""
    value = F.coalesce(text, F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(value, 256)).alias("digest"), F.octet_length(value).cast("long").alias("n_bytes"), F.xxhash64(value).alias("proof"))


def merge_runs(rows: DataFrame, keep: str = "largest", ways: int = 8, run_rows: int = 250_000) -> DataFrame:
    """Groups (digest, n_bytes, proof, keep_id, group_size) of ``digests`` rows.

    Every partition first folds its own sorted run. Then, in k-nomial rounds, ``ways`` partitions at a time exchange runs:
    in round r the partitions whose slot numbers differ only in digit r swap rows by digit r of the digest, sort-merge what
    they receive and fold it, so every level keeps the verified smallest (or largest) identifier. After the last round a
    slot holds one part of the digest space. No task ever sees more than its part, and copies shrink at each level. A slot is
    a partition, and the runs that meet in one are merged by Spark's sort.
    """
    n, levels = rows.count(), 1
    while ways**levels * run_rows < n or levels < 2:
        levels += 1
    largest, missing = keep == "largest", -(2**63) if keep == "largest" else 2**63 - 1
    order = ["slot", "digest", "n_bytes", "proof"]
    # six bytes of the digest as a number below 2**48
    head = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    run = rows.select(F.pmod(F.spark_partition_id(), F.lit(ways**levels)).cast("long").alias("slot"), "digest", "n_bytes", "proof", F.coalesce("doc_id", F.lit(missing)).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    fold = lambda it: _merge(it, largest)
    run = run.sortWithinPartitions(*order).mapInArrow(fold, RUN)
    for level in range(levels):
        step = F.lit(ways**level)
        slot = F.col("slot") + (_digit(head, ways, level) - _digit(F.col("slot"), ways, level)) * step
        run = run.withColumn("slot", slot.cast("long")).repartitionById(ways**levels, F.col("slot").cast("int")).sortWithinPartitions(*order).mapInArrow(fold, RUN)
    return run.select("digest", "n_bytes", "proof", F.when(F.col("keep_id") != missing, F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", ways: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is an empty one and equals other empty ones. Of equal texts the row
    with the largest (or smallest) id stays; a null id loses to any other. Repeated rows of one id and text count one by
    one in group_size and all carry the same flag. Other columns are ignored, an empty table gives an empty result.
    """
    rows = stage(digests(docs, F.col(text_col), id_col), "digests")
    groups = stage(merge_runs(rows, keep, ways).where("group_size > 1"), "groups")
    groups = groups.select(F.struct("digest", "n_bytes", "proof").alias("run_key"), "keep_id", "group_size")
    joined = lookup(rows.withColumn("run_key", F.struct("digest", "n_bytes", "proof")), groups, "run_key")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id,
       CAST(count(*) OVER (PARTITION BY x) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
