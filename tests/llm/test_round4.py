"""Regression tests of the fourth round of findings about the operators."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import common, lm_score


def _texts():
    words = ["alpha", "beta", "gamma", "delta's", "12,5%", "…", "a b", "unforeseeable"]
    return [(i if i % 7 else None, " ".join(words[(i * k) % 8] for k in range(1, 1 + i * i % 400)) if i % 5 else None) for i in range(60)]


def _windows(spark, rows, parts, size, shards):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)).alias("learn"))
    chunks = common.stage(docs.mapInArrow(lambda it: lm_score._chunks(it, size), "chunk long, docs binary"), "chunks")
    found = lm_score.answered(chunks, path, 6, shards).where("fragment < 0").collect()
    assert len({r["fragment"] for r in found}) == len(found) <= shards
    return {r["fragment"]: lm_score._unpacked(bytes(r["keys"]), "<u2").reshape(-1, lm_score.WINDOW + 1) for r in found}


def test_every_id_of_every_training_text_is_in_one_window(spark):
    rows, encode = _texts(), lm_score.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    pairs = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            ids = [lm_score.END, *(int(x) for w in lm_score.split(t) for x in lm_score.word_ids(w, encode))]
            pairs.update(zip(ids, ids[1:]))
    few = _windows(spark, rows, 2, 10_000_000, 7)
    got = Counter()
    for w in few.values():
        for one in w.tolist():
            ids = [x for x in one if x != lm_score.PAD]
            assert len(ids) > 1 and one == ids + [lm_score.PAD] * (lm_score.WINDOW + 1 - len(ids))
            got.update(zip(ids, ids[1:]))
    assert got == pairs
    many = _windows(spark, rows, 5, 300, 7)  # the same shards, however the texts are packed
    assert few.keys() == many.keys() and all(np.array_equal(few[k], many[k]) for k in few)


@pytest.mark.parametrize("n, steps", [(1000, 1), (1000, 60), (10, 5), (64, 1), (65, 3)])
def test_all_windows_are_learnt_from(monkeypatch, n, steps):
    rng, seen, forward = np.random.default_rng(3), set(), lm_score._logits
    windows = rng.integers(0, lm_score.IDS, (n, lm_score.WINDOW + 1)).astype("<u2")
    windows[:, 0] = np.arange(n)
    windows[::3, 5:] = lm_score.PAD
    monkeypatch.setattr(lm_score, "_logits", lambda model, rows: (seen.update(rows[:, 0].tolist()), forward(model, rows))[1])
    row = np.minimum(np.arange(lm_score.IDS), lm_score.OWN - 1)
    model = lm_score.new_model()
    for part in range(3):
        model = lm_score.train(model, windows, np.zeros(lm_score.IDS, int), row, part, 3, steps)
    assert seen == set(range(n)) and all(np.isfinite(w).all() for w in model.values())


def test_training_follows_the_gradient():
    """A step of Adam goes against the sign of the loss's slope, as differences tell it."""
    rng = np.random.default_rng(5)
    windows = rng.integers(0, 50, (6, lm_score.WINDOW + 1)).astype("<u2")
    windows[0, 9:] = windows[1, 20:] = lm_score.PAD
    row, classes = np.arange(lm_score.IDS) % lm_score.OWN, rng.integers(0, lm_score.CLASSES, lm_score.IDS)
    start = {k: w.astype("f4") for k, w in lm_score.new_model(1).items()}
    start["r"] = rng.standard_normal(lm_score.WINDOW).astype("f4") * 0.1

    def loss(model):
        real = windows[:, 1:] != lm_score.PAD
        z = lm_score.forward({k: w.astype("f8") for k, w in model.items()}, row[np.minimum(windows[:, :-1], 50)])[0]
        goal = classes[np.minimum(windows[:, 1:], 50)]
        return -np.take_along_axis(z, goal[:, :, None], 2)[:, :, 0][real].mean()

    after = lm_score.train(start, windows, classes, row, 0, 1, 1)
    for name, w in start.items():
        for at in rng.choice(min(w.size, 40 * lm_score.WIDTH), 12, replace=False):
            far = {s: start | {name: w.astype("f8").copy()} for s in (-1, 1)}
            for s in far:
                far[s][name].flat[at] += s * 1e-3
            slope = (loss(far[1]) - loss(far[-1])) / 2e-3
            if abs(slope) > 1e-4:
                assert np.sign(after[name].flat[at] - w.flat[at]) == -np.sign(slope), (name, at)


def test_packets_and_segments_are_held_a_few_at_a_time(spark, monkeypatch):
    """Row groups and batches for Python hold a few packets, however many rows a task reads."""
    import glob
    import re

    import pyarrow.parquet as pq

    from clauseloom.llm import token_alignment as align

    def groups(df):
        folder = re.sub("^file:/+", "/", df.inputFiles()[0].rsplit("/", 1)[0])
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
        return [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]

    assert sorted(groups(common.stage(spark.range(0, 30, 1, 1), "few", 4))) == [2, *[4] * 7]
    held, stage = {}, align.stage

    def keep(df, name, *a):
        out = stage(df, name, *a)
        held[name] = (max(groups(out)), int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return out

    monkeypatch.setattr(align, "stage", keep)
    rows = [(i, f"word{i % 9} and more of text {i}, as it goes on. " * (1 + 300 * (i % 10 == 0))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert align.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), segment=100).count() == 150
    assert all(held[name][0] <= align.SEGMENTS_HELD for name in ("segments", "fragments", "long-packets"))
    assert held["packets"][0] <= align.PACKETS_HELD and held["asked"][1] == held["totals"][1] == align.PACKETS_HELD
    assert all(held[name][1] == align.SEGMENTS_HELD for name in ("segments", "fragments", "closed", "hashes", "long-packets"))
