"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, stage


#: How far guests go, in standard deviations of a difference along the line between two centres.
REACH = 3.0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes, with a digest of the vector's own values; null for vectors that link with nothing."""
    for batch in batches:
        keys, units, dims = [], [], []
        for row in batch["embedding"]:
            v = row.values.to_numpy(zero_copy_only=False).astype("f8") if row.is_valid and len(row.values) else np.zeros(1)
            top = np.abs(v).max()
            ok = np.isfinite(top) and top > 0
            v = v / top if ok else v  # first by the largest component, so that no square overflows
            keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
            units.append((v / math.sqrt(v @ v)).tobytes() if ok else None)
            dims.append(len(v))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "key", "unit", "dim"])


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    centres = units[np.random.default_rng(seed).permutation(len(units))[:k]].copy()
    for _ in range(rounds):
        home = np.concatenate([(units[a : a + 2048] @ centres.T).argmax(1) for a in range(0, len(units), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def spreads(sample: np.ndarray, threshold: float, pairs: int = 50, step: int = 512) -> list[np.ndarray]:
    """Covariances by which differences of partners may spread over directions, each of trace 1: that of the sample, and that of
    the differences of partners within it, where it holds ``pairs`` of them at least."""
    centred = sample - sample.mean(0)
    found = [centred.T @ centred]
    total, n = np.zeros_like(found[0]), 0
    for at in range(0, len(sample), step):
        i, j = np.nonzero(sample[at : at + step] @ sample.T >= threshold)
        keep = at + i < j
        d = sample[at + i[keep]] - sample[j[keep]]
        d /= np.sqrt((d * d).sum(1, keepdims=True)) + 1e-12  # every pair counts alike, however close
        total, n = total + d.T @ d, n + len(d)
    if n >= pairs:
        found.append(total)
    return [m / np.trace(m) for m in found if np.trace(m) > 1e-12]


def _reaches(centres: np.ndarray, covariances: list[np.ndarray], threshold: float, reach: float | None) -> np.ndarray:
    """How far from the plane between centres i and h a vector may lie to be a guest: at most the length of a difference at the
    threshold, which misses nothing; else ``reach`` standard deviations of its part along the centres' difference."""
    longest = math.sqrt(max(0.0, 2 - 2 * threshold))
    share = np.zeros((len(centres), len(centres)))
    for m in covariances:
        own = np.einsum("id,de,ie->i", centres, m, centres, optimize=True)
        along = own[:, None] + own[None] - 2 * centres @ m @ centres.T
        share = np.maximum(share, along / np.maximum(2 - 2 * (centres @ centres.T), 1e-18))
    if reach is None or not covariances:
        share[:] = 1
    else:
        share = np.minimum(1, reach * np.sqrt(np.maximum(share, 0)))
    return share * longest + 1e-9


def _cells(batches: Iterator[pa.RecordBatch], centres) -> Iterator[pa.RecordBatch]:
    """Each vector to its own cell and, as a guest, to each other cell that may hold a partner of it.

    If x lies in cell i and y in cell h, the plane halfway between the centres parts them, and y is no further from that
    plane than the part of x - y that is square to it (see ``_reaches``).
    """
    c, reaches = centres.value
    if len(c):
        far = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-18))
    for batch in batches:
        rep, n, dim, raw = (batch[k].to_pylist() for k in ("rep", "n", "dim", "unit"))
        dims = np.array(dim)
        out_row, out_cell = [], []
        usual = np.flatnonzero(dims == c.shape[1]) if len(c) else np.zeros(0, int)
        for at in range(0, len(usual), 2048):
            some = usual[at : at + 2048]
            s = np.frombuffer(b"".join(raw[i] for i in some)).reshape(len(some), -1) @ c.T
            home = s.argmax(1)
            margin = (s[np.arange(len(some)), home][:, None] - s) / far[home]
            margin[np.arange(len(some)), home] = -1
            r, i = np.nonzero(margin <= reaches[home])
            out_row.append(some[r])
            out_cell.append(np.where(i == home[r], i, -1 - i))
        odd = np.flatnonzero(dims != c.shape[1]) if len(c) else np.arange(len(dims))
        out_row.append(odd)
        out_cell.append(10**9 + dims[odd])
        rows, cells = np.concatenate(out_row).astype(int), np.concatenate(out_cell).astype("i8")
        own = cells >= 0
        yield pa.RecordBatch.from_arrays([pa.array(np.where(own, cells, -1 - cells), pa.int64()), pa.array(own), pa.array([rep[i] for i in rows], pa.int64()), pa.array([n[i] for i in rows], pa.int64()), pa.array([raw[i] for i in rows], pa.binary())], names=["cell", "own", "rep", "n", "unit"])


def _compare(threshold: float, step: int = 512):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of one block against those of another: links of each row, and the smallest id that the pair of blocks joins it to."""
        left, right = pdf[pdf["row"]], pdf[~pdf["row"]]
        none = pd.DataFrame({"rep": pd.Series(dtype="i8"), "links": pd.Series(dtype="i8"), "label": pd.Series(dtype="i8")})
        if not len(left) or not len(right):
            return none
        a, b = (np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) for x in (left, right))
        ids, others, n = left["rep"].to_numpy(), right["rep"].to_numpy(), right["n"].to_numpy()
        found = []
        for at in range(0, len(a), step):
            i, j = np.nonzero(a[at : at + step] @ b.T >= threshold)
            keep = ids[at + i] != others[j]
            found.append((at + i[keep], j[keep]))
        i, j = (np.concatenate(x) for x in zip(*found))
        links = np.bincount(i, weights=n[j], minlength=len(ids)).astype("i8")
        at, to = ids.copy(), others.copy()
        while True:
            before = at.copy(), to.copy()
            np.minimum.at(at, i, to[j])
            np.minimum.at(to, j, at[i])
            if (before[0] == at).all() and (before[1] == to).all():
                break
        some, there = links > 0, np.bincount(j, minlength=len(others)) > 0
        return pd.DataFrame({"rep": np.concatenate([ids[some], others[there]]), "links": np.concatenate([links[some], np.zeros(there.sum(), "i8")]), "label": np.concatenate([at[some], to[there]])})

    return block


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = 2500, sample_rows: int = 8192, most_cells: int = 8192, block_rows: int = 2048, guest_rows: int = 8192, reach: float | None = REACH) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are collapsed first and counted. Centres of about one cell per ``cell_rows`` vectors (``most_cells`` at most)
    are fitted on a sample of ``sample_rows``, or of eight for each cell; every vector goes to its cell and, as a guest, to
    each cell from which a partner is likely to come: ``reach`` standard deviations of a difference, by the sample's own
    spread, and with ``reach`` None as far as any partner can lie, which makes the search exact. Pairs are then judged by their exact cosine. A cell is
    compared block by block, each pair
    of blocks a task of its own that returns counts and one label per vector instead of pairs, so neither a hot cell nor
    a large group of copies meets in one task.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of other
    lengths. Repeated rows count as vectors of their own. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("embedding"))
    rows = stage(raw.mapInArrow(_units, "vec_id long, key binary, unit binary, dim int"), "units")
    groups = stage(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit"), F.min("dim").alias("dim")), "vectors")
    dim = groups.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    centres = reaches = np.zeros((0, 0))
    if dim is not None:
        cells = max(1, min(dim[1] // cell_rows, most_cells))
        some = groups.where(F.col("dim") == dim[0]).orderBy(F.xxhash64("key"), "key").limit(max(sample_rows, 8 * cells)).select("unit").collect()
        sample = np.frombuffer(b"".join(bytes(r[0]) for r in some)).reshape(len(some), -1)
        centres = spherical_kmeans(sample, max(1, min(cells, len(some) // 8)))
        reaches = _reaches(centres, spreads(sample[:sample_rows], threshold), threshold, reach)
    shared = spark.sparkContext.broadcast((centres, reaches))
    cells = stage(groups.mapInArrow(lambda it: _cells(it, shared), "cell long, own boolean, rep long, n long, unit binary"), "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count_if("own") / block_rows).alias("own_blocks"), F.ceil(F.count(F.lit(1)) / guest_rows).alias("blocks"))
    placed = cells.join(F.broadcast(stage(sizes.where("own_blocks > 0"), "sizes")), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n))
    left = placed.where("own").select("cell", block("own_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("row"), "rep", "n", "unit")
    right = placed.select("cell", every("own_blocks").alias("i"), block("blocks").alias("j"), F.lit(False).alias("row"), "rep", "n", "unit")
    found = stage(left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(_compare(threshold), "rep long, links long, label long"), "links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = groups.select("key", "rep", "n").join(sums, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = stage(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")), "groups")
    out = lookup(rows.select("vec_id", "key"), known, "key")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
