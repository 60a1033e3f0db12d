"""From documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from clauseloom.llm.common import lookup, shared_dir, stage as staged, tidy

#: The columns of the documents table, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a key ``_row`` of each row, and whether that is its id.

    It is where all ids differ and none is null; else rows are numbered, and written once so that the numbers stay.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").take(1):
        return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed"), False
    return docs.withColumn("_row", F.col("doc_id")), True


def _accepted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for scored in quality._score(iter([batch]), shared):
            yield batch.filter(pc.greater_equal(scored["score"], quality.THRESHOLD))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model does not reject by their own text; it learns from labelled documents of its own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    shared = spark.sparkContext.broadcast(quality.train_quality(docs, labels))
    rows = docs.select(*COLUMNS)
    return rows.mapInArrow(tidy(lambda it: _accepted(it, shared)), rows.schema)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the largest id (a null id loses to any other); a null text equals an empty one."""
    rows = staged(exact_dedup.digests(docs, F.col("text")), "digests")
    groups = staged(exact_dedup.merge_runs(rows).where("group_size > 1"), "groups")
    groups = groups.select(F.struct("digest", "n_bytes", "proof").alias("run_key"), "keep_id", "group_size")
    value = F.coalesce("text", F.lit(""))
    run_key = F.struct(F.unhex(F.sha2(value, 256)).alias("digest"), F.octet_length(value).cast("long").alias("n_bytes"), F.xxhash64(value).alias("proof"))
    known = lookup(docs.select(*COLUMNS, run_key.alias("run_key")), groups, "run_key")
    several = known.where(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    folded = several.groupBy("run_key").agg(F.max(F.struct(*COLUMNS)).alias("best")).select("best.*")
    return known.where("group_size is null").select(*COLUMNS).unionByName(folded)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by Jaccard similarity of 0.8 or more, the one with the smallest id, null ids last."""
    rows, own = _keyed(docs)
    groups = ngram_join.jaccard_components(rows, id_col="_row").withColumnRenamed("doc_id", "_row")
    if own:
        picks = groups.where("_row = component_id").select("_row")
    else:
        named = groups.join(rows.select("_row", "doc_id"), "_row")
        picks = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")).select("first._row")
    return lookup(rows, staged(picks.withColumn("_kept", F.lit(True)), "picks"), "_row").where("_kept").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row as often as it is taken whole, and once more cut to the words that its source still owes.

    Every copy carries the words taken of it; the words of a cut copy are joined by single spaces.
    """
    keyed, _ = _keyed(docs)
    rows = mixing.taken(keyed, id_col="_row").where("taken > 0").select(F.col("doc_id").alias("_row"), "size", "taken")
    both = lookup(keyed, rows, "_row").where("taken is not null")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " ")
    copies = F.concat(F.array_repeat(F.col("text"), whole.cast("int")), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return both.select("doc_id", F.explode(copies).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mix), ("packing", pack)]

#: Learned scores and a tokenizer decide the result; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if at + 1 == len(STAGES):
            return out
        path = f"{shared_dir(spark)}/stage-{at}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
