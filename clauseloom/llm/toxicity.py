"""Toxicity by classifier chains: categories in order, each model fed with the earlier ones' probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .embedding_dedup import spherical_kmeans
from .quality import held_out

#: The chain's categories: kinds of toxic texts that the labelled ones themselves show, then the label.
CATEGORIES = ["kind_1", "kind_2", "toxic"]
_WORDS = re.compile(r"[^\W\d_]+")
#: Words whose weights a worker keeps; beyond that the store is emptied.
KEPT_WORDS = 500_000


def features(word: str) -> list[str]:
    """What stands for a word: itself, and its beginnings, which other forms share."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array([sorted(words(t)) for t in batch["text"].to_pylist()], pa.list_(pa.string()))], names=["label", "words"])


class Sparse:
    """Rows of feature counts, as index and count lists."""

    def __init__(self, docs: list[dict[int, float]], width: int):
        self.width, self.rows = width, len(docs)
        self.row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.col = np.array([i for d in docs for i in d], int)
        self.val = np.array([x for d in docs for x in d.values()], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 200, decay: float = 5e-5) -> np.ndarray:
    """Weights of features, then of ``extra`` columns, then the bias, fitted on the rows ``use`` by full gradients.

    Feature weights stay at 0 or above: a text is no less toxic for the harmless words around."""
    theta = np.zeros(x.width + extra.shape[1] + 1)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(1, use.sum())
    for step in range(1, steps + 1):
        gap = np.where(use, y - _sigmoid(_raw(x, extra, theta)), 0) / n
        grad = np.r_[x.back(gap), extra.T @ gap, gap.sum()] - decay * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[: x.width] = np.maximum(theta[: x.width], 0)
    return theta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _raw(x: Sparse, extra: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return x.dot(theta[: x.width]) + extra @ theta[x.width : -1] + theta[-1]


def kinds_of(sets: list[set[str]], toxic: np.ndarray, many: int, kept: int = 500, least: int = 8) -> list[np.ndarray]:
    """Narrower categories that come from the data: the toxic training texts clustered by the features they hold more often than
    others do, by spherical k-means. Fewer than ``least`` toxic texts: no text is of any kind."""
    none = [np.zeros(len(sets), int) for _ in range(many)]
    rude = np.flatnonzero(toxic)
    whole, within = Counter(), Counter()
    for i, s in enumerate(sets):
        own = {f for w in s for f in features(w)}
        whole.update(own)
        if toxic[i]:
            within.update(own)
    share = len(rude) / max(1, len(sets))
    gap = {f: (c - whole[f] * share) / np.sqrt(whole[f] * share + 0.5) for f, c in within.items() if c >= 2}
    index = {f: k for k, f in enumerate(sorted((f for f in gap if gap[f] > 2), key=lambda f: (-gap[f], f))[:kept])}
    if len(rude) < least or not index:
        return none
    x = np.zeros((len(rude), len(index)))
    for r, i in enumerate(rude):
        for w in sets[i]:
            for f in features(w):
                if f in index:
                    x[r, index[f]] = 1
    x /= np.sqrt(x.sum(0)) + 1e-12  # common features tell less of the kind
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    held = norms[:, 0] > 0
    x = x[held] / norms[held]
    if len(x) < many:
        return none
    home = (x @ spherical_kmeans(x, many).T).argmax(1)
    for k in range(many):
        none[k][rude[held][home == k]] = 1
    return none


def fit_chain(docs: list[list[str]], toxic: np.ndarray, folds: int = 5, kept: int = 2000) -> dict:
    """The chain's models. Each category after the first sees the earlier ones' probabilities, predicted for a training row
    by models that were fitted on the other folds, so that they look in training as they will on new texts."""
    names = CATEGORIES
    sets = [set(d) for d in docs]
    y = np.stack([*kinds_of(sets, toxic, len(names) - 1), toxic], 1).reshape(-1, len(names))
    whole, within = Counter(), [Counter() for _ in names]
    for s, labels in zip(sets, y):
        own = {f for w in s for f in features(w)}
        whole.update(own)
        for k in np.flatnonzero(labels):
            within[k].update(own)
    chosen: set[str] = set()
    for k in range(len(names)):
        share = y[:, k].sum() / max(1, len(docs))
        gap = {f: (c - whole[f] * share) / np.sqrt(whole[f] * share + 0.5) for f, c in within[k].items() if whole[f] >= 2}
        chosen |= set(sorted((f for f in gap if gap[f] > 2), key=lambda f: (-gap[f], f))[:kept])
    index = {f: i for i, f in enumerate(sorted(chosen))}

    def row(s: set[str]) -> dict[int, float]:
        out: dict[int, float] = {}
        for w in s:
            for f in features(w):
                if f in index:
                    out[index[f]] = out.get(index[f], 0) + 1
        return out

    x = Sparse([row(s) for s in sets], len(index))
    fold = np.arange(len(docs)) % folds
    before, models = np.zeros((len(docs), 0)), []
    for k in range(len(names)):
        models.append(logistic(x, before, y[:, k], np.ones(len(docs), bool)))
        if k + 1 < len(names):
            out = np.zeros(len(docs))
            for f in range(folds):
                theta = logistic(x, before, y[:, k], fold != f)
                out[fold == f] = _sigmoid(_raw(x, before, theta))[fold == f]
            before = np.c_[before, out]
    weights = np.stack([m[: len(index)] for m in models], 1) if index else np.zeros((0, len(names)))
    return {"index": index, "weights": weights, "links": [m[len(index) : -1] for m in models], "bias": [float(m[-1]) for m in models]}


def chain_probabilities(sums: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities by category from the summed word weights, one category after the other."""
    p = np.zeros_like(sums)
    for k in range(sums.shape[1]):
        p[:, k] = _sigmoid(sums[:, k] + p[:, :k] @ model["links"][k] + model["bias"][k])
    return p



def _score(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    index, weights = model["index"], model["weights"]
    known: dict[str, int] = {}  # of a word, the row of its weights in ``table``; 0: it has none
    table = [np.zeros(len(names))]

    def learn(word: str) -> int:
        own = [weights[index[f]] for f in features(word) if f in index]
        if len(known) > KEPT_WORDS:
            known.clear()
        known[word] = len(table) if own else 0
        if own:
            table.append(np.sum(own, 0))
        return known[word]

    for batch in batches:
        sums = np.zeros((batch.num_rows, len(names)))
        for i, text in enumerate(batch["text"].to_pylist()):
            if len(table) > KEPT_WORDS:
                known.clear()
                del table[1:]
            rows = [r if (r := known.get(w)) is not None else learn(w) for w in words(text)]
            for r in rows:
                if r:
                    sums[i] += table[r]
        p = chain_probabilities(sums, model)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(p[:, k], pa.float64()) for k in range(len(names)))], names=["doc_id", *(f"p_{n}" for n in names)])


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The chain, fitted on at most ``sample`` labelled documents that are not held out, half of them toxic where there are
    so many; which ones goes by a hash of the id. Labels other than 0 and 1 and null ids are passed over; several labels of
    one document count as the largest. The distinct words of the sample reach the driver."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    some = stage(known.where("label = 1").orderBy(*order).limit(sample // 2).unionByName(known.where("label = 0").orderBy(*order).limit(sample - sample // 2)), "sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text")).select("label", "text")  # one row of an id
    rows = rows.mapInArrow(_gather, "label int, words array<string>").collect()
    rows = sorted(((r["words"], r["label"]) for r in rows), key=lambda r: (r[1], r[0]))
    fold = np.random.default_rng(3).permutation(len(rows))
    return fit_chain([rows[i][0] for i in fold], np.array([rows[i][1] for i in fold], int))


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one probability per category, over the whole text of every row.

    Null, empty and wordless texts get the chain's base rates. Repeated rows score alike; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    names = CATEGORIES
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _score(it, shared, names), "doc_id long, " + ", ".join(f"p_{n} double" for n in names))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.4) -> DataFrame:
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.withColumn("held_out", held_out()).withColumn("score", F.col("p_toxic")).withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("toxic", F.col("predicted") == 1)


def op3_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
