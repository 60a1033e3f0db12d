"""Chunks and exact cosine search."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[^A-Za-z0-9_]+")


def fact_chunks(facts: DataFrame) -> DataFrame:
    """Facts (doc_id, value, char_start, char_end) of five characters or more, with their place before the value."""
    text = F.format_string("[characters %d-%d] %s", "char_start", "char_end", "value")
    return facts.where(F.length(F.trim("value")) >= 5).select("doc_id", F.lit("fact").alias("chunk_type"), text.alias("text"))


def clause_chunks(clauses: DataFrame) -> DataFrame:
    return clauses.select("doc_id", F.lit("clause").alias("chunk_type"), F.concat(F.lit("["), "clause_type", F.lit("] "), "heading").alias("text"))


def binding_chunks(bindings: DataFrame) -> DataFrame:
    return bindings.select("doc_id", F.lit("binding").alias("chunk_type"), F.concat("term", F.lit(" means "), "resolves_to").alias("text"))


def hash_embedding(rows: DataFrame, text_col: str = "text", width: int = 384) -> DataFrame:
    """Adds ``raw``, the signed sums of the text's words by hashed place, and ``v``, the same at length one (0 for no words).

    A word's place is the first 32 bits of its MD5 digest modulo twice the width; places beyond the width count as less one.
    """
    places: dict[str, int] = {}

    def place(word: str) -> int:
        if (at := places.get(word)) is None:
            if len(places) > 500_000:
                places.clear()
            at = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * width)
        return at

    def embed(batches):
        for batch in batches:
            raws, units = np.zeros((batch.num_rows, width), "i4"), np.zeros((batch.num_rows, width))
            for i, text in enumerate(batch[text_col].to_pylist()):
                both = np.bincount([place(w) for w in _NOT_WORD.split((text or "").lower()) if w], minlength=2 * width)
                raws[i] = both[:width] - both[width:]
            norms = np.sqrt((raws.astype("i8") ** 2).sum(1, keepdims=True))
            np.divide(raws, norms, out=units, where=norms > 0)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(kind)) for x, kind in ((raws, pa.int32()), (units, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "raw", "v"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(embed, schema + ", raw array<int>, v array<double>")


def _best(k: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": pd.Series(dtype="i8"), "id": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8")})
        a, b = (np.stack(x["v"].to_numpy()).astype("f8") for x in (q, r))
        a, b = (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) for x in (a, b))
        s = np.round(a @ b.T, 4)
        ids = r["id"].to_numpy()
        rows = [np.lexsort((ids, -line))[:k] for line in s]
        return pd.DataFrame({"query_id": np.repeat(q["id"].to_numpy(), [len(x) for x in rows]), "id": np.concatenate([ids[x] for x in rows]), "score": np.concatenate([line[x] for line, x in zip(s, rows)])})

    return block


def search(queries: DataFrame, rows: DataFrame, k: int = 10, block_rows: int = 4096, within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine for each (id, v) query, score rounded to 4 places, ties by id.
    With ``within`` only rows that have the query's own value in that column (its document).

    Blocks of queries meet blocks of rows, each pair in a task of its own that returns its own k best; these are few, and the
    global ranking sees only them.
    """
    scope = (F.col(within) if within else F.lit(0)).alias("scope")
    one = lambda df, name: df.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))
    sizes = F.broadcast(one(queries, "nq").join(one(rows, "nr"), "scope"))  # one row, or one for each document that is asked
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = queries.select("id", "v", scope).join(sizes, "scope").select("scope", "id", "v", F.lit(True).alias("query"), block("nq").alias("i"), every("nr").alias("j"))
    right = rows.select("id", "v", scope).join(sizes, "scope").select("scope", "id", "v", F.lit(False).alias("query"), every("nq").alias("i"), block("nr").alias("j"))
    found = left.unionByName(right).groupBy("scope", "i", "j").applyInPandas(_best(k), "query_id long, id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def topped_up(found: DataFrame, facts: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """(query_id, id, place): the found facts (query_id, group, id, rank) of a query's document, each once; where they are fewer
    than ``least``, the document's other facts (group, id) follow in order, up to ``most`` in all."""
    once = found.groupBy("query_id", "group", "id").agg(F.min("rank").alias("rank"))
    few = once.groupBy("query_id", "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    first = facts.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("id"))).where(F.col("k") <= most).drop("k")
    more = few.join(first, "group").join(once.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = once.select("query_id", "id", F.lit(0).alias("later"), "rank").unionByName(more.select("query_id", "id", F.lit(1).alias("later"), F.col("id").alias("rank")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("later", "rank"))
    return both.withColumn("place", place).where((F.col("later") == 0) | (F.col("place") <= most)).select("query_id", "id", "place")
