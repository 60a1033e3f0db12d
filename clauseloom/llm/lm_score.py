"""Language-model scoring: causal self-attention over subword ids, with word counts of the whole training corpus."""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage, tidy
from .embedding_dedup import spherical_kmeans
from .ngram_join import _WORD, _mix, slices, word_hashes

#: Split pattern of the byte-level vocabulary, its size with the end token, and the end token.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
IDS, END = 50257, 50256
#: Tokens a window holds, and the step between windows: a window scores its last STRIDE tokens, those before are context.
WINDOW, STRIDE = 32, 24
#: Width of the model, output classes (of word beginnings and of continuations), ids with an embedding of their own.
WIDTH, STARTS, OTHERS, OWN = 16, 40, 24, 2048
CLASSES = STARTS + OTHERS

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level vocabulary at ``path`` (lines of a base64 token and its rank)."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def start_ids(path: str) -> np.ndarray:
    """Which ids can only begin a word (those with a leading space, and the end)."""
    flags = np.zeros(IDS, bool)
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            flags[int(rank)] = base64.b64decode(token).startswith(b" ")
    flags[END] = True
    return flags


def word_ids(word: bytes, encode) -> np.ndarray:
    return np.array(encode(" " + word.decode()), "<u2") if word else np.array([END], "<u2")


_ODD = re.compile(r"\s")


def many_word_ids(words: list[bytes], encode, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each has. Words without white space inside (of any kind) are encoded
    together: they are cut apart at their leading spaces, and an id that begins with a space begins a word."""
    size, texts, plain, odd = np.ones(len(words), "<u4"), [w.decode() for w in words], [], {}
    for i, t in enumerate(texts):
        if not t or _ODD.search(t):
            odd[i] = word_ids(words[i], encode)
        else:
            plain.append(i)
    ids = np.array(encode(" " + " ".join([texts[i] for i in plain])) if plain else [], "<u2")
    heads = np.flatnonzero(begins[ids])
    if len(heads) != len(plain):  # a space stands for itself somewhere: word by word then
        odd |= {i: word_ids(words[i], encode) for i in plain}
        plain, ids, heads = [], ids[:0], heads[:0]
    size[plain] = np.diff(np.r_[heads, len(ids)])
    for i, x in odd.items():
        size[i] = len(x)
    pool = np.empty(size.sum(), "<u2")
    begin = np.cumsum(size, dtype="i8") - size
    own = size[plain].astype("i8")
    pool[np.repeat(begin[plain] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
    for i, x in odd.items():
        pool[begin[i] : begin[i] + len(x)] = x
    return pool, size


def split(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only), and b'' for the end."""
    return [*(text or "").encode().lower().split(), b""]


# --- the model -------------------------------------------------------------------------------------------------------


COMMON, KNOWN = 300, 3000


def company(windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the KNOWN most frequent ids has each of the COMMON ones before and after it, in windows (see ``_cut``)."""
    common, known = np.argsort(-counts, kind="stable")[:COMMON], np.argsort(-counts, kind="stable")[:KNOWN]
    column, row = np.full(PAD + 1, -1), np.full(PAD + 1, -1)
    column[common], row[known] = np.arange(COMMON), np.arange(KNOWN)
    total = np.zeros(KNOWN * 2 * COMMON, "i8")
    for at in range(0, len(windows), 20_000):
        one, two = windows[at : at + 20_000, :-1].ravel(), windows[at : at + 20_000, 1:].ravel()
        for here, there, side in ((one, two, 0), (two, one, COMMON)):
            ok = np.flatnonzero((row[here] >= 0) & (column[there] >= 0))
            total += np.bincount(row[here[ok]] * 2 * COMMON + side + column[there[ok]], minlength=len(total))
    return total.reshape(KNOWN, -1)


def make_classes(near: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class for every id: ids that stand in like company, word beginnings apart from continuations; rare ids last."""
    known = np.argsort(-counts, kind="stable")[:KNOWN]
    seen = near.sum(1) >= 20
    near = np.sqrt(near.astype("f8"))
    near /= np.sqrt((near * near).sum(1, keepdims=True)) + 1e-12
    classes = np.where(starts, STARTS - 1, CLASSES - 1)
    for flag, first, many in ((True, 0, STARTS - 1), (False, STARTS, OTHERS - 1)):
        own = np.flatnonzero(seen & (starts[known] == flag))
        if len(own):
            centres = spherical_kmeans(near[own], min(many, len(own)))
            classes[known[own]] = first + (near[own] @ centres.T).argmax(1)
    return classes


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many targets: (document, first target, first scored place) of each window, no target scored twice.
    A document's first window begins before the document, with places that stay empty."""
    many = -(-lengths // STRIDE)
    doc = np.repeat(np.arange(len(lengths)), many)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, turn * STRIDE - (WINDOW - STRIDE), np.full(len(doc), WINDOW - STRIDE)


_LATER = np.triu(np.ones((WINDOW, WINDOW), bool), 1)
_APART = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None], 0, None)


def _level(x: np.ndarray, bound: float) -> None:
    """Takes the largest off each last row where an exponent could overflow else."""
    if bound > 60:
        x -= x.max(-1, keepdims=True)


def _logits(model: dict, rows: np.ndarray):
    """What stands for each class after each place of (windows, places) embedding rows, with what training needs again."""
    x = np.take(model["E"], rows, axis=0)
    flat = x.reshape(-1, WIDTH)
    agree = model["Q"] @ model["K"].T / np.float32(np.sqrt(WIDTH))
    u, v = (flat @ agree).reshape(x.shape), (flat @ model["V"]).reshape(x.shape)
    a = u @ x.transpose(0, 2, 1)
    bound = max(a.max(), -a.min()) + np.abs(model["r"]).max()
    a += np.where(_LATER, np.float32(-1e9), model["r"][_APART]).astype("f4")
    _level(a, bound)
    np.exp(a, out=a)
    a /= (a @ np.ones(WINDOW, a.dtype))[:, :, None]
    h = a @ v
    h += x
    z = h.reshape(-1, WIDTH) @ model["O"]
    z += model["b"]
    return z, (x, agree, u, v, a, h)


def forward(model: dict, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Class log-probabilities after each place of (windows, places) embedding rows."""
    z, parts = _logits(model, rows)
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z.reshape(*rows.shape, -1), parts


def new_model(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    f = lambda *shape: (rng.standard_normal(shape) * 0.2).astype("f4")
    return {"E": f(OWN + CLASSES, WIDTH), "Q": f(WIDTH, WIDTH), "K": f(WIDTH, WIDTH), "V": f(WIDTH, WIDTH), "r": np.zeros(WINDOW, "f4"), "O": f(WIDTH, CLASSES), "b": np.zeros(CLASSES, "f4")}


def train(model: dict, windows: np.ndarray, classes: np.ndarray, row: np.ndarray, part: int, parts: int, steps: int, batch: int = 64) -> dict:
    """Part ``part`` of ``parts`` of fitting the attention model of ids to classes of the next id, by Adam; numpy only.

    The windows are taken in their order, ``batch`` at a step, and from the first one again after the last: in as many steps
    as all of them take, and no fewer than ``steps``, so that over all parts every window is learnt from.
    """
    model = {k: w.copy() for k, w in model.items()}
    steps = max(steps, -(-len(windows) // batch))
    first, last = part * steps // parts, (part + 1) * steps // parts
    row, classes = np.append(row, 0), np.append(classes, 0)  # of the place after the last id
    m, u = {k: np.zeros_like(w) for k, w in model.items()}, {k: np.zeros_like(w) for k, w in model.items()}
    scale, column = np.float32(np.sqrt(WIDTH)), np.arange(WIDTH)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    for step in range(first, last):
        ids = np.minimum(windows[np.arange(step * batch, step * batch + min(batch, len(windows))) % len(windows)], IDS).astype("i4")
        real = ids[:, 1:] < IDS
        rows, goal = row[ids[:, :-1]], classes[ids[:, 1:]]
        d, (x, agree, q, v, a, h) = _logits(model, rows)
        _level(d, max(d.max(), -d.min()))
        np.exp(d, out=d)
        share = (real / np.float32(max(1, real.sum()))).astype("f4").ravel()
        d *= (share / (d @ np.ones(CLASSES, "f4")))[:, None]
        d[np.arange(len(d)), goal.ravel()] -= share
        g = {"O": flat(h).T @ d, "b": d.sum(0)}
        dh = (d @ model["O"].T).reshape(x.shape)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("btk,btk->bt", ds, a)[:, :, None]
        ds *= a
        g["r"] = np.bincount(_APART.ravel(), ds.sum(0).ravel() * ~_LATER.ravel(), WINDOW).astype("f4")
        dq, dv = ds @ x, a.transpose(0, 2, 1) @ dh
        da = flat(x).T @ flat(dq)
        g["Q"], g["K"], g["V"] = da @ model["K"] / scale, da.T @ model["Q"] / scale, flat(x).T @ flat(dv)
        dx = dh + ds.transpose(0, 2, 1) @ q
        dx += (flat(dq) @ agree.T + flat(dv) @ model["V"].T).reshape(x.shape)
        g["E"] = np.bincount((rows.reshape(-1, 1) * WIDTH + column).ravel(), dx.ravel(), model["E"].size).reshape(-1, WIDTH).astype("f4")
        done = step - first + 1
        rate = 0.02 * min(1, 2 * (1 - (step + 1) / (steps + 1)))
        for name, w in model.items():
            m[name] *= np.float32(0.9)
            m[name] += np.float32(0.1) * g[name]
            u[name] *= np.float32(0.99)
            u[name] += np.float32(0.01) * np.square(g[name])
            w -= np.float32(rate / (1 - 0.9**done)) * m[name] / (np.sqrt(u[name] / np.float32(1 - 0.99**done)) + np.float32(1e-6))
    return model


def folded(model: dict) -> dict:
    """The model for scoring: projections applied to the embeddings once, so that a token's rows are looked up instead; and
    whether no exponent can overflow, by the largest products there are, so that no maximum needs to be taken off."""
    out = model | {"TQ": model["E"] @ (model["Q"] @ model["K"].T / np.float32(np.sqrt(WIDTH))), "TV": model["E"] @ model["V"]}
    out["R"] = np.where(_LATER, np.float32(-1e9), model["r"][_APART]).astype("f4")
    top = lambda x: float(np.abs(x).max())
    agree = top(out["TQ"] @ model["E"].T) + top(model["r"])
    out["safe"] = max(agree, top(model["E"] @ model["O"]) + top(out["TV"] @ model["O"]) + top(model["b"])) < 60
    return out


def score_streams(model: dict, streams: list[np.ndarray], chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For every id of each stream but its first: log P(id | before) and log P(a word begins | before), one after the other.

    Each token is scored once, with at least WINDOW - STRIDE tokens of context where there are so many; windows of all
    documents go in batches, and only the places that a window scores ask.
    """
    lengths = np.array([len(s) - 1 for s in streams])
    base, out = np.r_[0, np.cumsum(lengths + 1)[:-1]], np.r_[0, np.cumsum(lengths)[:-1]]
    flat = np.concatenate(streams)
    rows, goals, within = model["row"][flat].astype("i4"), model["classes"][flat].astype("i4"), model["within"][flat]
    token, begin = np.zeros(lengths.sum()), np.zeros(lengths.sum())
    doc, first, _ = windows_of(lengths)
    skip, safe = WINDOW - STRIDE, model["safe"]
    keys, asks, line = np.arange(WINDOW), np.arange(skip, WINDOW), np.arange(chunk * STRIDE)
    begins_or_any, ones = np.ones((CLASSES, 2), "f4"), np.ones(WINDOW, "f4")
    begins_or_any[STARTS:, 0] = 0
    later = model["R"][skip:]
    opening = later.copy()
    opening[:, :skip] = -1e9  # places before the document
    for some, bias in ((np.flatnonzero(first < 0), opening), (np.flatnonzero(first >= 0), later)):
        for c in range(0, len(some), chunk):
            w = some[c : c + chunk]
            d, f = doc[w], first[w]
            last = lengths[d][:, None]
            row = rows[base[d][:, None] + np.clip(f[:, None] + keys, 0, last - 1)]
            x = np.take(model["E"], row, axis=0)
            a = np.take(model["TQ"], row[:, skip:], axis=0) @ x.transpose(0, 2, 1)
            a += bias
            if not safe:
                a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
            h = a @ np.take(model["TV"], row, axis=0)
            h /= (a @ ones)[:, :, None]
            h += x[:, skip:]
            z = h.reshape(-1, WIDTH) @ model["O"]
            z += model["b"]
            if not safe:
                z -= z.max(1, keepdims=True)
            ask = f[:, None] + asks
            at = (base[d][:, None] + np.minimum(ask, last - 1) + 1).ravel()
            goal = z[line[: len(z)], goals[at]]
            np.exp(z, out=z)
            sums = z @ begins_or_any
            np.log(sums + np.float32(1e-30), out=sums)
            use = (ask < last).ravel()
            to = (out[d][:, None] + ask).ravel()[use]
            token[to] = (goal - sums[:, 1] + within[at])[use]
            begin[to] = (sums[:, 0] - sums[:, 1])[use]
    return token, begin


#: What stands in a window after its last id.
PAD = 65535


def _cut(ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids end to end (``lengths``: how many each has) cut to windows: a hash of each, of its text's number and its place,
    and its ids, one more than WINDOW. A text's first window begins with END and each other one with the last id of
    the one before, so that every id follows in one window; places after a text's last id hold PAD."""
    many = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), many)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = (np.cumsum(lengths) - lengths)[text] + turn * WINDOW - 1
    at = begin[:, None] + np.arange(WINDOW + 1)
    out = np.append(ids, PAD)[np.minimum(at, len(ids))].astype("<u2")
    out[at >= np.cumsum(lengths)[text][:, None]] = PAD
    out[turn == 0, 0] = END
    return (_mix(turn.astype("u8") + _mix(doc[text].astype("u8") + np.uint64(29))) >> np.uint64(32)).astype("<u4"), out


def _shard(keys: list[bytes], windows: list[bytes]) -> bytes:
    """The windows of one shard, in the order of their hashes and then their ids."""
    key = np.concatenate([np.frombuffer(k, "<u4") for k in keys])
    rows = np.concatenate([np.frombuffer(w, "<u2") for w in windows]).reshape(-1, WINDOW + 1)
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same):  # their order is that in which they came
        some = np.unique(np.r_[same, same + 1])
        rows = rows.copy()
        rows[some] = rows[some[np.lexsort((*rows[some].T[::-1], key[some]))]]
    return _packed(rows)


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), kind)


def _packed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


SUMS = "part long, n long, packed binary"


def _summed(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """What ``work``, in whole numbers, gives for the shards of a task, added up."""
    total, n = None, 0
    for batch in batches:
        for blob in batch["windows"].to_pylist():
            own = work(_unpacked(blob, "<u2").reshape(-1, WINDOW + 1))
            total, n = own if total is None else total + own, n + 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([_packed(total)], pa.binary())], names=["part", "n", "packed"])


def _added(table: pa.Table) -> pa.Table:
    """Packed arrays added up, with how many shards they are of."""
    total = 0
    for x in table["packed"].to_pylist():
        total = total + _unpacked(x, "i8")
    return pa.table({"n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "packed": pa.array([_packed(total)], pa.binary())})


def _over_shards(windows: DataFrame, work) -> tuple[int, np.ndarray]:
    """What ``work`` gives for the windows of every shard, added up; at most eight arrays reach the driver. They are of whole
    numbers, so that the order in which they are added changes nothing."""
    sums = windows.mapInArrow(tidy(lambda it: _summed(it, work)), SUMS).groupBy(F.col("part") % 8).applyInArrow(_added, "n long, packed binary").collect()
    return sum(r["n"] for r in sums), sum(_unpacked(bytes(r["packed"]), "i8") for r in sums)


#: Weights are added up as whole numbers of this fraction.
_UNIT = 2.0**-32


def shards_of(size: int, shard_windows: int = 96_000, every: int = 80) -> int:
    """How many shards windows of training texts of so many bytes are dealt to, at about one window in ``every`` bytes."""
    return max(1, round(size / every / shard_windows))


def fit(windows: DataFrame, path: str, counts: np.ndarray, rounds: int = 3, steps: int = 1500) -> dict:
    """The attention model, fitted on all windows of all training texts; ``windows``: of each shard a row.

    Every id of every training text is learnt, as what follows those before it in its window. Windows are dealt by hash to
    shards; in each of ``rounds`` every shard trains from the mean of all on its next windows, in ``steps`` steps or as many as it
    takes to see all of its own, so that the work of a task stays the same. Nothing depends on how the rows are partitioned.
    """
    starts, model = start_ids(path), new_model()
    classes = np.where(starts, STARTS - 1, CLASSES - 1)
    learnt = bool(windows.take(1))
    if learnt:
        _, near = _over_shards(windows, lambda w: company(w, counts).ravel())
        classes = make_classes(near.reshape(KNOWN, -1), counts, starts)
    row = OWN + classes
    top = np.argsort(-counts, kind="stable")[:OWN]
    row[top] = np.arange(len(top))
    if learnt:
        ends = np.cumsum([w.size for w in model.values()])
        for part in range(rounds):
            now = model
            whole = lambda w, part=part, now=now: np.concatenate([np.rint(x.ravel().astype("f8") / _UNIT).astype("i8") for x in train(now, w, classes, row, part, rounds, steps).values()])
            n, flat = _over_shards(windows, whole)
            model = {k: (x * (_UNIT / n)).astype("f4").reshape(w.shape) for (k, w), x in zip(model.items(), np.split(flat, ends[:-1]))}
    else:
        model |= {"O": np.zeros_like(model["O"])}  # nothing learnt: all classes alike
    return model | {"classes": classes, "row": row}


# --- the corpus ------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Documents packed and compressed to chunks of about ``limit`` bytes of text, the units that are counted and scored."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            held.append(some)
            size += pc.sum(pc.binary_length(some["text"])).as_py()
            if size >= limit:
                yield packed()
                held, size, number = [], 0, number + 1
    if held:
        yield packed()


def _read(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def vocabulary(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct words by ascending hash, the hashes, how often its training documents hold them; and, document by
    document, the words in their order, each by its place among the distinct ones, with their number per document."""
    hashes, sizes, views, held = [], [], [], 0
    for _, data, offsets in slices(pa.concat_arrays(table["text"].cast(pa.large_string()).chunks) if table.num_rows else pa.array([], pa.large_string())):
        inside = _WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        end[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        own = np.diff(np.searchsorted(s, offsets))
        put = np.arange(len(s)) + np.repeat(np.arange(len(own)), own)  # an end after every document: the empty word, of hash 0
        h, at = np.zeros(len(s) + len(own), "u8"), np.zeros((2, len(s) + len(own)), "i8")
        h[put], at[0, put], at[1, put] = word_hashes(data, s, e), s, e
        hashes.append(h)
        sizes.append(own + 1)
        views.append((held, data, at))
        held += len(h)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, "u8")
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, int)
    distinct, first, which = np.unique(flat, return_index=True, return_inverse=True)
    learn = np.repeat(table["learn"].to_numpy(zero_copy_only=False).astype(bool), lengths) if table.num_rows else np.zeros(0, bool)
    n = np.bincount(which[learn], minlength=len(distinct)).astype("u4")
    words: list[bytes] = [b""] * len(distinct)
    part = np.searchsorted([v[0] for v in views], first, side="right") - 1
    for i, (p, f) in enumerate(zip(part, first)):
        start, data, at = views[p]
        words[i] = data[at[0, f - start] : at[1, f - start]].tobytes().lower()
    return words, distinct, n, which, lengths


PACKED = "fragment long, chunk long, hashes binary, counts binary, sizes binary, ids binary"


def _table(rows: list[tuple], names: str) -> pa.Table:
    """A table of (fragment, chunk, bytes, ...) rows; ``names`` is its schema for Spark."""
    fields = [pa.field(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in map(str.split, names.split(", "))]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))


def _count(batches: Iterator[pa.RecordBatch], path: str, bits: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's word counts, packed by fragment of the hash space, with the subword ids of its training words; and, under
    fragment numbers beyond the last, the keys of the id pairs in its words, whose counts it asks for. Under numbers below 0 the
    windows of its training texts, by their shard."""
    encode, begins = encoder(path).encode_ordinary, start_ids(path)
    for batch in batches:
        for chunk, blob in zip(batch["chunk"].to_pylist(), batch["docs"].to_pylist()):
            docs = _read(blob)
            words, hashes, n, which, lengths = vocabulary(docs)
            pool, size = many_word_ids(words, encode, begins)
            if shards:
                yield from _table(_windows(docs, which, lengths, pool, size, chunk, shards), PACKED).to_batches()
            asked = np.unique(pair_key(*word_pairs(pool.astype(int), size)))
            pool, size = pool[np.repeat(n > 0, size)], np.where(n > 0, size, 0).astype("<u4")
            begin = np.r_[0, np.cumsum(size, dtype="i8")]
            cut = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype="u8"))
            rows = [(k, chunk, hashes[x:y].tobytes(), n[x:y].tobytes(), size[x:y].tobytes(), pool[begin[x] : begin[y]].tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            rows += [((1 << bits) + k, chunk, keys.tobytes(), b"", b"", b"") for k, keys in by_fragment(asked, pair_bits(bits))]
            yield from _table(rows, PACKED).to_batches()


def _windows(docs: pa.Table, which: np.ndarray, lengths: np.ndarray, pool: np.ndarray, size: np.ndarray, chunk: int, shards: int) -> list[tuple]:
    """The windows of a chunk's training texts, by shard; some texts at a time."""
    learn = docs["learn"].to_numpy(zero_copy_only=False).astype(bool)
    doc = np.array([(i or 0) % 2**64 for i in docs["doc_id"].to_pylist()], "u8")
    begin, own, word = np.cumsum(size, dtype="i8") - size, size.astype("i8"), np.r_[0, np.cumsum(lengths)]
    keys, windows, at = [], [], 0
    while at < len(lengths):
        upto = max(at + 1, int(np.searchsorted(word, word[at] + 100_000, "right")) - 1)
        words = which[word[at] : word[upto]][np.repeat(learn[at:upto], lengths[at:upto])]
        n = own[words]
        ids = pool[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.r_[0, np.cumsum(n)][np.cumsum(lengths[at:upto][learn[at:upto]])]
        key, rows = _cut(ids, np.diff(ends, prepend=0), doc[at:upto][learn[at:upto]])
        keys.append(key)
        windows.append(rows)
        at = upto
    if not keys or not any(map(len, keys)):
        return []
    key, rows = np.concatenate(keys), np.concatenate(windows)
    shard = (key % np.uint32(shards)).astype("i8")
    order = np.argsort(shard, kind="stable")
    cut = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
    return [(-1 - k, chunk, key[order[x:y]].tobytes(), b"", b"", rows[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]


ANSWER = "fragment long, chunk long, counts binary, keys binary"


def _answer(table: pa.Table, bits: int) -> pa.Table:
    """One fragment: for every chunk the corpus counts of its words, in their order; under chunk -1 the sums by subword id and,
    by fragment of the pair keys, the counts of id pairs in the fragment's training words, each word once. Keys asked for go through.
    A shard's windows come together."""
    fragment, chunks = table["fragment"][0].as_py(), table["chunk"].to_pylist()
    if fragment < 0:
        return _table([(fragment, -1, b"", _shard(table["hashes"].to_pylist(), table["ids"].to_pylist()))], ANSWER)
    if fragment >> bits:
        return _table([(fragment, c, b"", keys) for c, keys in zip(chunks, table["hashes"].to_pylist())], ANSWER)
    parts = [np.frombuffer(x, "u8") for x in table["hashes"].to_pylist()]
    hashes = np.concatenate(parts)
    n, size, pool = (np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()]) for name, kind in (("counts", "u4"), ("sizes", "<u4"), ("ids", "<u2")))
    order = np.argsort(hashes, kind="stable")
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
    totals = np.empty(len(n), "i8")
    totals[order] = np.add.reduceat(n[order].astype("i8"), np.flatnonzero(new))[np.cumsum(new) - 1]
    rows = [(fragment, c, t.tobytes(), b"") for c, t in zip(chunks, np.split(totals, np.cumsum([len(x) for x in parts])[:-1]))]
    # every training word once, from any chunk that trains with it
    learnt = np.flatnonzero(n)
    one = learnt[np.unique(hashes[learnt], return_index=True)[1]]
    if len(one):
        own, many = size[one].astype(int), totals[one]
        begin = np.r_[0, np.cumsum(own)[:-1]]
        pool = pool[np.repeat((np.cumsum(size, dtype="i8") - size)[one] - begin, own) + np.arange(own.sum())].astype(int)
        before, after = word_pairs(pool, own)
        sums = np.stack([np.bincount(pool[begin], many, IDS), np.bincount(pool[begin], minlength=IDS), np.bincount(pool, np.repeat(many, own), IDS), np.bincount(before, minlength=IDS), np.bincount(after, minlength=IDS)]).astype("i8")
        at = np.flatnonzero(sums.any(0))
        rows.append((fragment, -1, sums[:, at].tobytes(), at.astype("<u2").tobytes()))
        keys, times = np.unique(pair_key(before, after), return_counts=True)
        done = 0
        for k, some in by_fragment(keys, pair_bits(bits)):
            rows.append(((1 << bits) + k, -1, times[done : done + len(some)].astype("i8").tobytes(), some.tobytes()))
            done += len(some)
    return _table(rows, ANSWER)


def _answer_pairs(table: pa.Table) -> pa.Table:
    """One fragment of the pair keys: for every chunk the counts of the pairs it asks for, in their order."""
    fragment = table["fragment"][0].as_py()
    rows = list(zip(table["chunk"].to_pylist(), table["counts"].to_pylist(), table["keys"].to_pylist()))
    given = [(np.frombuffer(keys, "<u4"), np.frombuffer(n, "i8")) for c, n, keys in rows if c < 0]
    keys = np.concatenate([np.zeros(0, "<u4"), *(k for k, _ in given)])
    n = np.concatenate([np.zeros(0, "i8"), *(x for _, x in given)])
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    n = np.r_[np.add.reduceat(n[order], first) if len(first) else n, 0]
    out = []
    for c, _, asked in rows:
        if c >= 0:
            asked = np.frombuffer(asked, "<u4")
            at = np.searchsorted(keys, asked)
            known = np.r_[keys, 0][at] == asked
            out.append((fragment, c, n[np.where(known & (at < len(keys)), at, len(keys))].tobytes()))
    return _table(out, ASKED)


ASKED = "fragment long, chunk long, counts binary"


def _sum_ids(table: pa.Table) -> pa.Table:
    """The sums by subword id of some fragments, added up: five numbers for each id."""
    total = np.zeros((5, IDS), "i8")
    for n, at in zip(table["counts"].to_pylist(), table["keys"].to_pylist()):
        at = np.frombuffer(at, "<u2").astype(int)
        total[:, at] += np.frombuffer(n, "i8").reshape(5, -1)
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def answered(chunks: DataFrame, path: str, bits: int, shards: int = 0) -> DataFrame:
    """What ``_answer`` says to the chunks, in folders by ``kind``: 0 of words, 1 of id pairs; with ``shards`` also 2, the windows of
    all training texts, dealt to so many."""
    packed = chunks.mapInArrow(tidy(lambda it: _count(it, path, bits, shards)), PACKED)
    told = packed.groupBy("fragment").applyInArrow(lambda t: _answer(t, bits), ANSWER)
    kind = F.when(F.col("fragment") < 0, 2).when(F.col("fragment") < 1 << bits, 0).otherwise(1)
    folder = f"{shared_dir(chunks.sparkSession)}/answers-{uuid.uuid4().hex}"
    told.withColumn("kind", kind).write.partitionBy("kind").parquet(folder)
    return chunks.sparkSession.read.schema(f"{ANSWER}, kind int").parquet(folder)


def counted(chunks: DataFrame, path: str, bits: int, answers: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """(fragment, chunk, counts) of every chunk's words and, in fragments from 2**bits on, of the id pairs in them; and for each
    id the training words that begin with it, by occurrence and once each, its occurrences, and those in the distinct words
    before and after another id."""
    answers = answered(chunks, path, bits) if answers is None else answers
    words = F.col("kind") == 0
    pairs = stage(answers.where("kind = 1").groupBy("fragment").applyInArrow(_answer_pairs, ASKED), "pairs")
    sums = answers.where(words & (F.col("chunk") == -1)).groupBy(F.col("fragment") % 16).applyInArrow(_sum_ids, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"], "i8").reshape(5, -1) for r in sums), np.zeros((5, IDS), "i8"))
    return answers.where(words & (F.col("chunk") >= 0)).select("fragment", "chunk", "counts").unionByName(pairs), total


#: The attention model's share beside the pairs of neighbouring ids within words.
SHARE = 0.3


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number below 2**32 for each pair, different for different ones and spread evenly; END after the last id of a word
    stands for the word's end."""
    return ((before.astype("u8") * np.uint64(IDS) + after.astype("u8")) * np.uint64(0x9E3779B1)).astype("<u4")


def pair_bits(bits: int) -> int:
    """Fragments of the pair keys: a quarter of those of the words, which are the larger table."""
    return max(6, bits - 2)


def by_fragment(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Ascending keys cut by their first ``bits`` bits, without empty parts."""
    cut = np.searchsorted(keys >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
    return [(k, keys[x:y]) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]


def word_pairs(pool: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words laid end to end: each id, and the one after it within its word (END after the last)."""
    after = np.r_[pool[1:], END] if len(pool) else pool
    after[np.cumsum(size, dtype="i8") - 1] = END
    return pool, after


def pair_odds(pair: np.ndarray, before: np.ndarray, after: np.ndarray, m: dict) -> np.ndarray:
    """Shares of the next ids after an id, from the pairs' counts and one more that is spread like all next ids; they sum to 1."""
    return (pair + m["broad"][after]) / (m["pair_total"][before] + 1)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(chunk: pa.Table, answers: pa.Table, shared, path: str, bits: int) -> pa.Table:
    """Scores of one chunk's documents, from its words' corpus counts and the attention model."""
    m = shared.value
    docs = _read(chunk["docs"][0].as_py())
    words, _, _, which, lengths = vocabulary(docs)
    parts = sorted(zip(answers["fragment"].to_pylist(), answers["counts"].to_pylist()))
    count, asked = (np.frombuffer(b"".join(x for k, x in parts if (k >> bits > 0) == of_pairs), "i8").astype("f8") for of_pairs in (False, True))
    pool, size = many_word_ids(words, encoder(path).encode_ordinary, start_ids(path))
    pool, size = pool.astype(int), size.astype(int)
    begin = np.r_[0, np.cumsum(size)]
    head = pool[begin[:-1]]
    base = np.log10((count + 0.5) / (m["tokens"] + 0.5 * (m["distinct"] + 1)))
    # of a word, given its first id: how often the corpus goes on like that, and the share left to unseen ends
    whole, kinds = m["head_count"][head], m["head_kinds"][head]
    ended = head == END
    seen = np.where(ended, 1.0, np.where(whole > 0, count / (whole + kinds + 1e-300), 0.0))
    spare = np.where(ended, 0.0, np.where(whole > 0, kinds / (whole + kinds + 1e-300), 1.0))
    # the ids after the first, and a word's end, by the pairs of ids in the corpus' distinct words
    before, following = word_pairs(pool, size)
    pair = asked[np.unique(pair_key(before, following), return_inverse=True)[1]]
    odds = pair_odds(pair, before, following, m)
    ids, ends = docs["doc_id"].to_pylist(), np.cumsum(lengths)
    known, bases, scores, sizes = [], [], [], []
    for first in range(0, len(ids), 64):
        lists = [which[e - n : e] for e, n in zip(ends[first : first + 64], lengths[first : first + 64])]
        streams, spans = [], []
        for at in lists:
            n = size[at]
            starts = np.r_[0, np.cumsum(n)[:-1]]
            where = np.repeat(begin[at] - starts, n) + np.arange(n.sum())
            streams.append(np.r_[END, pool[where]])
            spans.append((starts, n, odds[where]))
        token, start = score_streams(m, streams)
        done = 0
        for at, (starts, n, chance) in zip(lists, spans):
            total = n.sum()
            t, b = token[done : done + total], start[done : done + total]
            done += total
            opening = t[starts] - b[starts]  # a word begins here, that much is known
            going = np.r_[t[1:], 0.0]  # what the model gives the id after each place, or a new word where this one ends
            going[starts[1:] - 1] = b[starts[1:]]
            rest = np.add.reduceat(np.log(SHARE * np.exp(np.minimum(going, 0)) + (1 - SHARE) * chance + 1e-300), starts)
            p = opening + np.log(np.maximum(seen[at] + spare[at] * np.exp(np.minimum(rest, 0)), 1e-300))
            scores.append(float(p.sum() / np.log(10)))
            bases.append(float(base[at].sum()))
            known.append(int((count[at] > 0).sum()))
            sizes.append(len(at))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([not x for x in docs["learn"].to_pylist()], pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})


def lm_score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 10_000_000, training: dict | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 5 is 1 are held out; the others train. Documents are packed to chunks. Each
    chunk sends its word counts to fragments of the hash space (words by 64-bit hash); there they are summed over all chunks,
    and the sums go back to the chunks that hold the words. Pairs of neighbouring ids are counted there over the corpus'
    distinct training words, summed by fragment of the pair keys and sent to the chunks that ask for them, all exactly. The
    attention model, of the class of the next subword id, is fitted in numpy on all windows of all training texts (see ``fit``, to
    which ``training`` goes but for ``shard_windows`` and ``every``, which deal the windows); ids within a class follow their counts in the whole training corpus. A word's probability is that of
    its first id by the model, times the corpus' share of the word among those that begin so, backed off (with the weight
    of the number of such words) to the other ids one by one: by the model, and by the pairs of ids in the corpus' words. ``score`` is the sum of log10 over
    words and end.

    Null text: empty, so only the end is scored. A null id trains. Repeated rows train and score one by one. No training
    rows: counts of 0 everywhere. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)))
    chunks = stage(rows.select("doc_id", "text", "learn").mapInArrow(lambda it: _chunks(it, chunk_bytes), "chunk long, docs binary"), "chunks")
    bits = max(6, math.ceil(math.log2(max(1, chunks.count() / 8))))
    told = dict(training or {})
    dealt = {k: told.pop(k) for k in ("shard_windows", "every") if k in told}
    shards = shards_of(rows.where("learn").agg(F.sum(F.octet_length("text"))).first()[0] or 0, **dealt)
    answers = answered(chunks, vocabulary_path, bits, shards)
    asked, (head_count, head_kinds, counts, befores, afters) = counted(chunks, vocabulary_path, bits, answers)
    model = fit(answers.where("kind = 2").select(F.col("keys").alias("windows")), vocabulary_path, counts, **told)
    classes, smooth = model["classes"], counts + 0.1
    model |= {"within": np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes]), "head_count": head_count, "head_kinds": head_kinds, "tokens": head_count.sum(), "distinct": head_kinds.sum()}
    model |= {"pair_total": befores, "broad": (afters + 0.1) / (afters.sum() + 0.1 * IDS)}
    shared = spark.sparkContext.broadcast(folded(model))
    scored = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda d, w: _score(d, w, shared, vocabulary_path, bits), SCORED)
    return scored.withColumn("train_tokens", F.lit(int(head_count.sum())).cast("long"))


def op1_lm_score(spark, sf_dir):
    import public_tokenizers

    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
