"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stage

#: Multipliers of the block permutation, the primes 2**31 - 1 and 2**31 - 19: the second where the first divides the number of blocks.
STEP, OTHER = 2147483647, 2147483629
#: Levels of the tree between two spreadings of its nodes over the cluster.
SPREAD = 8

#: One hypergeometric draw from x = (all, own, take) and u in [0, 1): by inverse cumulative sum over the values within nine
#: standard deviations of the mode, weights relative to the mode's by the ratio of neighbours, going up first, then down.
_SPAN = """transform(array(x), x -> struct(x.total as total, x.own as own, x.take as take,
  cast(floor((x.take + 1D) * (x.own + 1D) / (x.total + 2D)) as bigint) as mode,
  cast(ceil(9 * sqrt(x.take * (x.own / greatest(x.total, 1)) * (1 - x.own / greatest(x.total, 1)) * (x.total - x.take) / greatest(x.total - 1, 1))) + 2 as bigint) as reach))"""
_UP = "(x.own - k) * 1D * (x.take - k) / ((k + 1D) * (x.total - x.own - x.take + k + 1D))"
_DOWN = "k * 1D * (x.total - x.own - x.take + k) / ((x.own - k + 1D) * (x.take - k + 1D))"
_TOP, _LOW = "least(x.mode + x.reach, x.own, x.take)", "greatest(x.mode - x.reach, 0, x.take + x.own - x.total)"
_SUM = f"""aggregate(sequence(x.mode, {_TOP}), struct(1D as w, 0D as s), (a, k) -> struct(a.w * {_UP} as w, a.s + a.w as s)).s
  + aggregate(sequence(x.mode, {_LOW}, -1), struct(1D as w, 0D as s), (a, k) -> struct(a.w * {_DOWN} as w, a.s + a.w as s)).s - 1D"""
_FIND = """aggregate(sequence(x.mode, %s), struct(1D as w, %s as left, cast(null as bigint) as at),
  (a, k) -> struct(a.w * %s as w, a.left - a.w as left, case when a.at is null and a.left < a.w then k else a.at end as at))"""
_DRAW = f"""transform({_SPAN}, x -> transform(array(u * ({_SUM})), goal -> transform(array({_FIND % (_TOP, 'goal', _UP)}), up ->
  coalesce(up.at, {_FIND % (f'{_LOW}, -1', 'up.left + 1D', _DOWN)}.at, x.mode))[0])[0])[0]"""


def _split(level: int, seed: int) -> str:
    """SQL that splits the array ``quota`` of a node in two: of each source, how many blocks go left."""
    u = f"(pmod(xxhash64(node, {level}, i, {seed}), 9007199254740992) / 9007199254740992D)"
    total = "aggregate(quota, 0L, (a, q) -> a + q)"
    step = f"""transform(array(struct(acc.total as total, q.q as own, acc.take as take)), x ->
      transform(array(struct({u} as u)), r -> ({_DRAW.replace('u * (', 'r.u * (', 1)}))[0])[0]"""
    step = step.replace("xxhash64(node, %d, i," % level, "xxhash64(node, %d, q.i," % level)
    return f"""aggregate(transform(quota, (q, i) -> struct(q as q, i as i)),
      struct({total} as total, ({total} + 1) div 2 as take, cast(array() as array<bigint>) as left),
      (acc, q) -> transform(array({step}), d -> struct(acc.total - q.q as total, acc.take - d as take, array_append(acc.left, d) as left))[0],
      acc -> acc.left)"""


def _permuted(rank, every, seed):
    """The block at ``rank`` of ``every`` in a source's affine order. Multiplied in two halves, which stay below 2**63 up to 2**46
    blocks of a source."""
    step = F.when(F.col(every) % STEP == 0, F.lit(OTHER)).otherwise(F.lit(STEP)).cast("long")
    high, low = F.shiftright(rank, 16), F.col(rank).bitwiseAND(F.lit(65535))
    product = F.pmod(F.pmod(high * step, F.col(every)) * 65536 + low * step, F.col(every))
    return F.pmod(product + F.pmod(F.xxhash64("number", F.lit(seed)), F.col(every)), F.col(every))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, skey, source_size, weight, target, number) of (source, skey, source_size): water filling under caps.

    Sources in code point order, null last, weigh ``cycle``, repeating. Targets share the sum of sizes by weight; one that
    passes ``epochs`` times its source's size stops there and the excess goes to the others by weight. Ordered by cap per
    weight the capped sources come first, and the final share per weight is the largest running one, so one sort does it.
    The table has one row per source; its windows run over that list alone.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("cap") / F.col("weight"), "number")
    rows = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("number") % len(cycle)).cast("int") + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    total, before = F.sum("source_size").over(Window.partitionBy()), F.sum("cap").over(by_cap) - F.col("cap")
    after = F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(by_cap) + F.col("weight")
    share = F.max((total - before).cast("double") / after.cast("double")).over(Window.partitionBy())
    return rows.withColumn("share", share).withColumn("target", F.least(F.col("weight") * F.col("share"), F.col("cap").cast("double"))).select("source", "skey", "source_size", "weight", "target", F.col("number").cast("int").alias("number"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), epochs: int = 3, block_words: int = 4096, shard_words: int = 4_000_000, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two tables: every input row with its size and target, and the pieces of the mix.

    Rows: row, doc_id, source, size, source_size, target. Pieces: row, doc_id, epoch, start, words, shard, order_key; a piece
    is ``words`` words of the document from ``start``, and a shard is read by order_key. The documents of a source lie in
    hashed order on a line, passed ``epochs`` times at most and cut into blocks of ``block_words``. A binary tree splits the
    numbers of blocks that each source owes, exactly, among 2**k shards: each node gives its left half a multivariate
    hypergeometric share, and each node carries the ranks at which its blocks begin, so that no sum over all shards is
    needed; every eight levels the nodes are spread over the cluster. A shard then draws its blocks, disjoint from all others', by an affine permutation and orders
    its pieces by hash. The same input gives the same mix. Sources are a list with one entry each in every tree node.

    Null text or one without words: size 0 and no pieces. A null source is a source of its own. Repeated rows count each
    by itself. Ties in the hash go by id. Other columns are ignored; an empty table gives two empty tables.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    name = F.col(source_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), name.alias("source"), F.coalesce(F.concat(F.lit("s"), name), F.lit("-")).alias("skey"), words.alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("place"))
    rows = stage(rows, "sizes")
    sizes = stage(targets(rows.groupBy("source", "skey").agg(F.sum("size").alias("source_size")), cycle, epochs), "targets")
    n, total = rows.count(), sizes.agg(F.sum(F.floor(F.col("target") + 0.5))).first()[0] or 0
    known = lookup(rows, sizes.drop("source"), "skey")

    # where each document begins on its source's line: sums of hash ranges first, then within a range
    digits = max(1, math.ceil(math.log(max(n, 1) / 1000 + 1, 16)))
    known = known.withColumn("range", F.substring("place", 1, digits))
    ranges = known.groupBy("number", "range").agg(F.sum("size").alias("all")).withColumn("base", F.sum("all").over(Window.partitionBy("number").orderBy("range")) - F.col("all")).drop("all")
    inside = Window.partitionBy("number", "range").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    lined = known.join(ranges, ["number", "range"]).withColumn("at", F.col("base") + F.sum("size").over(inside) - F.col("size"))

    # the tree of quotas, in blocks
    depth = max(0, math.ceil(math.log2(max(1, total / shard_words))))
    quota = F.ceil(F.floor(F.col("target") + 0.5) / block_words).cast("long")
    listed = sizes.agg(F.transform(F.sort_array(F.collect_list(F.struct("number", quota.alias("q")))), lambda s: s["q"]).alias("quota"))
    tree = listed.select(F.lit(0).cast("long").alias("node"), "quota", F.transform("quota", lambda q: F.lit(0).cast("long")).alias("first"))
    for level in range(depth):
        if level and level % SPREAD == 0:  # by now 256 nodes for each one that came from the last spreading
            tree = stage(tree.repartition("node"), "quotas")
        half = lambda quota, first: F.struct(quota.alias("quota"), first.alias("first"))
        left, right = half(F.col("left"), F.col("first")), half(F.zip_with("quota", "left", lambda q, x: q - x), F.zip_with("first", "left", lambda f, x: f + x))
        tree = tree.withColumn("left", F.expr(_split(level, seed))).select((F.col("node") * 2).alias("node"), F.posexplode(F.array(left, right)).alias("side", "half"))
        tree = tree.select((F.col("node") + F.col("side")).alias("node"), "half.quota", "half.first")
    tree = stage(tree, "quotas")
    shares = tree.select(F.col("node").alias("shard"), F.posexplode(F.arrays_zip("quota", "first")).alias("number", "share")).select("shard", "number", F.col("share.quota").alias("blocks"), F.col("share.first").alias("first"))
    shares = lookup(shares.where("blocks > 0"), sizes.select("number", quota.alias("all")), "number")
    drawn = shares.select("shard", "number", "all", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("rank"))
    drawn = drawn.select("shard", "number", _permuted("rank", "all", seed).alias("block"))

    # the part of the line [0, target) that each pass over a document covers, cut at block ends
    goal, size, at = F.floor(F.col("target") + 0.5), F.col("size"), F.col("at") + F.col("epoch") * F.col("source_size")
    passes = lined.where("size > 0").select("row", "doc_id", "number", "size", "source_size", "target", "at", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    passes = passes.withColumn("from", at).withColumn("to", F.least(at + size, goal)).where("`to` > `from`")
    blocks = F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))
    pieces = passes.select("row", "doc_id", "number", "epoch", "from", "to", F.explode(blocks).alias("block"))
    low, high = F.greatest("from", F.col("block") * block_words), F.least("to", (F.col("block") + 1) * block_words)
    pieces = pieces.select("row", "doc_id", "number", "epoch", "block", (low - F.col("from")).alias("start"), (high - low).alias("words")).join(drawn, ["number", "block"])
    order = F.xxhash64("shard", "block", "row", "epoch", F.lit(seed))
    return known.select("row", "doc_id", "source", "size", "source_size", "target"), pieces.select("row", "doc_id", "epoch", "start", "words", "shard", order.alias("order_key"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mix by input row: doc_id, source, size, source_size, target, taken."""
    rows, pieces = mix_sources(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op4_mixing(spark, sf_dir):
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
c AS (SELECT *, number % 3 + 1 AS weight, 3 * source_size AS cap FROM w),
r AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER by_cap - cap))::DOUBLE / (sum(weight) OVER () - sum(weight) OVER by_cap + weight)::DOUBLE AS running
  FROM c WINDOW by_cap AS (ORDER BY cap::DOUBLE / weight, number)
), t AS (SELECT source, source_size, least(weight * max(running) OVER (), cap::DOUBLE) AS target FROM r),
l AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(size, goal - begins)) + greatest(0, least(size, goal - begins - source_size)) + greatest(0, least(size, goal - begins - 2 * source_size)) AS BIGINT) AS taken
FROM l
"""
