"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tidy
from .ngram_join import _WORD, slices, word_hashes

_KIND = {name: np.zeros(256, bool) for name in ("upper", "lower", "digit", "mark", "shout", "odd", "bar", "stop", "high")}
_KIND["upper"][65:91] = True
_KIND["lower"][97:123] = True
_KIND["digit"][48:58] = True
_KIND["mark"][[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
for _name, _chars in (("shout", b"!"), ("odd", b"#$%&*"), ("bar", b"|"), ("stop", b".")):
    _KIND[_name][list(_chars)] = True
_KIND["high"][128:] = True
#: Features of one line; a line's vector holds them for itself, the line before and the line after.
OWN = 13
WIDTH = 3 * OWN + 2


def line_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slice of documents: lines per document, byte lengths of the lines, their feature vectors. No line left: one of length 0."""
    for _, data, offsets in slices(texts):
        rows = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        start = np.union1d(offsets[:-1], breaks + 1)
        start = start[start < len(data)] if len(data) else start[:0]
        end = np.minimum(np.r_[start[1:], len(data)], len(data))
        doc = np.searchsorted(offsets, start, side="right") - 1
        sums = {}
        begin = _WORD[data]
        begin[1:] &= ~_WORD[data[:-1]]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cuts] = _WORD[data[cuts]]
        for name, mask in (*((n, k[data]) for n, k in _KIND.items()), ("word", begin), ("solid", _WORD[data])):
            c = np.zeros(len(data) + 1, "i4")
            np.cumsum(mask, out=c[1:])
            sums[name] = (c[end] - c[start]).astype("f8")
        keep = sums["solid"] > 0
        # words that equal the word before them, by line
        first, last = np.flatnonzero(begin), np.flatnonzero(_WORD[data] & np.r_[~_WORD[data[1:]] | begin[1:], np.ones(min(1, len(data)), bool)]) + 1
        name = word_hashes(data, first, last)
        again = np.zeros(len(data) + 1, "i4")
        again[first[1:] + 1] = name[1:] == name[:-1]
        again = np.cumsum(again)
        sums["again"] = (again[end] - again[start]).astype("f8")
        start, end, doc = start[keep], end[keep], doc[keep]
        sums = {k: v[keep] for k, v in sums.items()}
        # a line is repeated if an equal one stands in the same document
        stop = end - (data[end - 1] == 10) if len(end) else end
        mark = word_hashes(data, start, stop)
        order = np.lexsort((mark, doc))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            equal = (mark[order][1:] == mark[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            same[1:] |= equal
            same[:-1] |= equal
        repeated = np.zeros(len(order), bool)
        repeated[order] = same
        size, words = np.maximum(sums["solid"], 1), np.maximum(sums["word"], 1)
        letters = np.maximum(sums["upper"] + sums["lower"], 1)
        one = np.stack([np.log1p(sums["solid"]) / 5, sums["upper"] / letters, sums["digit"] / size, sums["mark"] / size, sums["shout"] / words, sums["odd"] / words, sums["bar"] / words, sums["stop"] / words, size / words / 10, sums["high"] / size, repeated, sums["word"] < 3, sums["again"] / words], 1)
        # documents without a line get one without features
        missing = np.flatnonzero(np.bincount(doc, minlength=rows) == 0)
        doc, one, length = np.r_[doc, missing], np.r_[one, np.zeros((len(missing), OWN))], np.r_[sums["solid"], np.zeros(len(missing))]
        at = np.argsort(doc, kind="stable")
        doc, one, length = doc[at], one[at], length[at]
        head = np.r_[True, doc[1:] != doc[:-1]]
        tail = np.r_[head[1:], True]
        before, after = np.roll(one, 1, 0) * ~head[:, None], np.roll(one, -1, 0) * ~tail[:, None]
        yield np.bincount(doc, minlength=rows), length, np.concatenate([one, before, after, head[:, None], tail[:, None]], 1)


def marginals(counts: np.ndarray, odds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and expected transitions, by forward-backward in logs over all documents at once, line by line."""
    order = np.argsort(-counts, kind="stable")
    first = np.r_[0, np.cumsum(counts)[:-1]][order]
    length = counts[order]
    e = np.stack([np.zeros_like(odds), odds], 1)
    ahead, back = np.empty_like(e), np.zeros_like(e)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # documents of more than t lines
    for t in range(steps):
        at = first[: active[t]] + t
        if not t:
            ahead[at] = e[at]
        else:
            x = ahead[at - 1]
            ahead[at] = e[at] + np.stack([np.logaddexp(x[:, 0] + move[0, k], x[:, 1] + move[1, k]) for k in (0, 1)], 1)
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        x = back[at + 1] + e[at + 1]
        back[at] = np.stack([np.logaddexp(x[:, 0] + move[k, 0], x[:, 1] + move[k, 1]) for k in (0, 1)], 1)
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    inner = np.ones(len(odds), bool)
    inner[np.r_[0, np.cumsum(counts)[:-1]].astype(int)] = False
    to = np.flatnonzero(inner)
    pair = ahead[to - 1][:, :, None] + move[None] + (e[to] + back[to])[:, None, :]
    pair -= np.logaddexp(both[to, 0], both[to, 1])[:, None, None]
    return good, np.exp(pair).sum(0)


def _weighted(counts: np.ndarray, length: np.ndarray, good: np.ndarray) -> np.ndarray:
    start = np.r_[0, np.cumsum(counts)[:-1]].astype(int)
    weight = length + 1e-9
    return np.add.reduceat(weight * good, start) / np.add.reduceat(weight, start)


def fit_crf(counts: np.ndarray, length: np.ndarray, x: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120) -> dict:
    """Fit line weights and transitions from document labels: lines start with their document's label; after each round those
    of bad documents that the model finds good change sides, but for the worst line. A logistic curve maps the length-weighted
    mean of the marginals to the probability of label 1."""
    if not len(label) or label.min() == label.max():
        return {"w": np.zeros(WIDTH), "b": 0.0, "move": np.zeros((2, 2)), "curve": (0.0, 2.0 if not len(label) or label.max() else -2.0)}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.r_[0, np.cumsum(counts)[:-1]].astype(int)
    y = label[doc].astype("f8")
    theta = np.zeros(WIDTH + 5)
    inner = np.ones(len(y), bool)
    inner[start] = False
    to = np.flatnonzero(inner)
    for turn in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            good, moved = marginals(counts, z @ theta[:WIDTH] + theta[WIDTH], theta[WIDTH + 1 :].reshape(2, 2))
            gap = (y - good) / len(y)
            grad = np.r_[z.T @ gap, gap.sum(), ((seen - moved) / len(y)).ravel()] - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        good, _ = marginals(counts, z @ theta[:WIDTH] + theta[WIDTH], theta[WIDTH + 1 :].reshape(2, 2))
        if turn + 1 < rounds:
            worst = np.minimum.reduceat(good, start)[doc]
            y = np.where(label[doc] == 1, 1.0, ((good > 0.5) & (good > worst)).astype("f8"))
    q = _weighted(counts, length, good)
    t = np.log((q + 1e-3) / (1 - q + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * t + b)))
        a, b = a + 0.5 * (((label - p) * t).mean() - 1e-3 * a), b + 0.5 * (label - p).mean()
    w = theta[:WIDTH] / scale
    return {"w": w, "b": float(theta[WIDTH] - mean @ w), "move": theta[WIDTH + 1 :].reshape(2, 2), "curve": (float(a), float(b))}


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        scores = []
        for counts, length, x in line_features(batch["text"]):
            good, _ = marginals(counts, x @ m["w"] + m["b"], m["move"])
            q = _weighted(counts, length, good)
            scores.append(1 / (1 + np.exp(-(m["curve"][0] * np.log((q + 1e-3) / (1 - q + 1e-3)) + m["curve"][1]))))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "score"])


def _gather(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for counts, length, x in line_features(batch["text"]):
            begin = np.cumsum(counts) - counts
            # of a longer text a window of lines, from a place that its number of lines decides
            begin = begin + np.where(counts > lines, counts.astype("u8") * np.uint64(2654435761) % np.maximum(counts - lines + 1, 1).astype("u8"), 0).astype(int)
            out += [np.c_[length[a:b], x[a:b]].astype("f4").tobytes() for a, b in zip(begin, begin + np.minimum(counts, lines))]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(out, pa.binary())], names=["label", "lines"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, lines: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model, fitted on at most ``sample`` labelled documents, none of them held out; of those of more than ``lines`` lines
    on a window of so many.

    Which ones goes by a hash of the id; their line features, not their texts, reach the driver. Labels other than 0 and 1
    and null ids are passed over; several labels of one document count as the largest.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    some = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text")).select("label", "text")  # one row of an id
    rows = rows.mapInArrow(tidy(lambda it: _gather(it, lines)), "label int, lines binary").collect()
    parts = [np.frombuffer(r["lines"], "f4").reshape(-1, WIDTH + 1) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["label"], bytes(rows[i]["lines"])))  # the order of arrival must not matter
    if not parts:
        return fit_crf(np.zeros(0, int), np.zeros(0), np.zeros((0, WIDTH)), np.zeros(0, int))
    parts, label = [parts[i] for i in order], np.array([rows[i]["label"] for i in order])
    whole = np.concatenate(parts).astype("f8")
    return fit_crf(np.array([len(p) for p in parts]), whole[:, 0], whole[:, 1:], label)


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is better) for every row, computed over its whole text.

    Null and blank texts score as one line without features. Repeated rows score alike; a null id stays null; other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(lambda it: _score(it, shared)), "doc_id long, score double")


THRESHOLD = 0.3


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
