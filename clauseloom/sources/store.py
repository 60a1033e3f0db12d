"""Tables that are written once and read by many, and tables of versions: the sink of upserts, deletes and whole batches."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back, so that its readers share one run of it and a lost executor costs its tasks only."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class VersionedTables:
    """Parquet tables in hash buckets of a key column, and versions that say which files of all tables belong together.

    A commit writes only the buckets that its rows and deletes touch, each whole, under its own version; untouched buckets
    stay the files they are. One small file per version, written last, lists for every table and bucket the version that
    holds it: readers take the newest complete list, so they see all tables of a commit or none. A commit that is run again
    after a failure starts from the version before it and so replaces its own rows. Keys of rows are joined by sorting: files of keys
    pack so well that Spark takes millions of them for a small table and would send them through the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, list[str]], by: str = "doc_id", buckets: int = 16):
        """``keys``: of each table its primary key; every table has the column ``by``, of which buckets are hashes."""
        self.spark, self.folder, self.keys, self.by, self.buckets = spark, folder, dict(keys), by, buckets

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _listing(self, version: int) -> dict[tuple[str, int], tuple[int, int]]:
        """(table, bucket) to the version that holds it and its rows: at most one entry for each bucket of each table."""
        if not version:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/versions/{version}").collect()
        return {(r["table_name"], r["bucket"]): (r["held"], r["rows"]) for r in rows}

    def rows(self, version: int | None = None) -> dict[str, int]:
        """How many rows each table has, from the list of the version alone."""
        out = dict.fromkeys(self.keys, 0)
        for (table, _), (_, n) in self._listing(self.version() if version is None else version).items():
            out[table] += n
        return out

    def version(self) -> int:
        """The newest complete version, 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((n for n in names if self._exists(f"{self.folder}/versions/{n}/_SUCCESS")), default=0)

    def _paths(self, table: str, version: int, wanted: set[int] | None = None) -> list[str]:
        held = {b: v for (t, b), (v, n) in self._listing(version).items() if t == table and n and (wanted is None or b in wanted)}
        return [f"{self.folder}/{table}/version={v}/bucket={b}" for b, v in sorted(held.items())]

    def read(self, table: str, schema, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as of a version (the newest by default), or only some of its buckets."""
        paths = self._paths(table, self.version() if version is None else version, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket_of(self, value) -> F.Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def look_up(self, table: str, schema, keys: list) -> DataFrame:
        """The rows of a few values of ``by``: their buckets' files alone are opened, and pruned by the values inside."""
        at = self.spark.range(1).select(F.explode(F.array(*[F.lit(k).cast(schema[self.by].dataType) for k in keys])).alias("k")).select(self.bucket_of(F.col("k"))).distinct()
        return self.read(table, schema, buckets={r[0] for r in at.collect()}).where(F.col(self.by).isin(*keys))

    def commit(self, version: int, rows: Mapping[str, DataFrame], gone: DataFrame | None = None, whole: bool = False) -> DataFrame:
        """Make ``version`` of the one before it; (table_name, written, replaced, deleted) of every table that changed.

        Rows take the place of those with equal keys; with ``whole`` (and rows of ``gone`` always) all older rows of the same
        ``by`` go first, in every table. Equal keys within ``rows`` are the caller's to avoid. Done before: nothing happens.
        """
        counts = "table_name string, written long, replaced long, deleted long"
        if self._exists(f"{self.folder}/versions/{version}/_SUCCESS"):
            return self.spark.read.schema(counts).parquet(f"{self.folder}/counts/{version}")
        before = max((v for v in range(1, version) if self._exists(f"{self.folder}/versions/{v}/_SUCCESS")), default=0)
        listing, told = self._listing(before), []
        leave = gone.select(self.by) if gone is not None else None
        if whole:
            named = [df.select(self.by) for df in rows.values()]
            for df in named if leave is None else [leave, *named]:
                leave = df if leave is None or df is leave else leave.unionByName(df)
        if leave is not None:
            leave = staged(leave.distinct().withColumn("bucket", self.bucket_of(F.col(self.by))), "leaving")
            leaving = {r[0] for r in leave.select("bucket").distinct().collect()}
        for table in self.keys:
            new = rows.get(table)
            if new is None and leave is None:
                continue
            touched, n_new, sizes = {b for t, b in listing if t == table}, 0, {}
            if leave is not None:
                touched &= leaving
            if new is not None:
                new = staged(new.withColumn("bucket", self.bucket_of(F.col(self.by))), "incoming")
                sizes = {r[0]: r[1] for r in new.groupBy("bucket").agg(F.count(F.lit(1))).collect()}  # at most one for each bucket
                touched, n_new = (touched if leave is not None else set()) | set(sizes), sum(sizes.values())
            if not touched:
                continue
            schema = new.drop("bucket").schema if new is not None else self.spark.read.parquet(*self._paths(table, before)).schema
            old, fate = self.read(table, schema, before, touched), F.lit("left")
            after, fates, both = dict.fromkeys(touched, 0) | sizes, {}, new
            if any((table, b) in listing for b in touched):
                if leave is not None:
                    old, fate = old.join(leave.select(self.by, F.lit(True).alias("_leaves")).hint("merge"), self.by, "left"), F.when(F.col("_leaves"), "deleted").otherwise(fate)
                if new is not None:
                    old, fate = old.join(new.select(*self.keys[table], F.lit(True).alias("_again")).distinct().hint("merge"), self.keys[table], "left"), F.when(F.col("_again"), "replaced").otherwise(fate)
                old = staged(old.select(*schema.names, fate.alias("_fate")).withColumn("bucket", self.bucket_of(F.col(self.by))), "judged")
                for r in old.groupBy("_fate", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
                    fates[r["_fate"]] = fates.get(r["_fate"], 0) + r["n"]
                    after[r["bucket"]] += r["n"] * (r["_fate"] == "left")
                kept = old.where("_fate = 'left'").drop("_fate")
                both = kept if new is None else kept.unionByName(new)
            both.repartition("bucket").sortWithinPartitions("bucket", self.by).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/version={version}")
            told.append((table, n_new, fates.get("replaced", 0), fates.get("deleted", 0)))
            listing |= {(table, b): (version, n) for b, n in after.items()}
        self.spark.createDataFrame(told, counts).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/{version}")
        listed = self.spark.createDataFrame([(t, b, v, n) for (t, b), (v, n) in listing.items()], "table_name string, bucket int, held int, rows long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
        return self.spark.read.schema(counts).parquet(f"{self.folder}/counts/{version}")

    def clear(self, version: int) -> DataFrame:
        """A version in which all tables are empty; (table_name, rows) that each had, children first as listed in ``keys``."""
        had = self.spark.createDataFrame(list(self.rows().items()), "table_name string, rows long")
        self.spark.createDataFrame([], "table_name string, bucket int, held int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
        return had
