"""Jaccard self-join on word shingles by vertical partitioning: exact, with one row per document as its result."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, lookup, stage, tidy

#: Bytes of text that are hashed at once (a longer text makes a slice of its own), and least bits of the frequency sketch.
SLICE, BITS = 1_000_000, 20
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype="u8")
_LOWER[65:91] = _LOWER[97:123]  # A-Z count as a-z
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype="u8")
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column (nulls as empty) cut by bytes: first row, the bytes, and the rows' offsets in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[s:e], A-Z as a-z: the sum over its bytes of a random number drawn for the byte and its
    place in the word, so that no two words share a hash by the structure of the sum."""
    length = e - s
    total = np.cumsum(length)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length)
    keys = _LOWER[data[np.repeat(s, length) + place]] + (place.astype("u8") << np.uint64(8)) + np.uint64(1)
    sums = np.zeros(len(keys) + 1, "u8")
    np.cumsum(_mix(keys * np.uint64(_BASE)), out=sums[1:])
    return _mix(sums[total] - sums[total - length] + length.astype("u8") * np.uint64(_STEP))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words, computed over whole slices at once."""
    for _, data, offsets in slices(texts):
        rows = len(offsets) - 1
        if not len(data):
            yield from (np.zeros(0, "u8") for _ in range(rows))
            continue
        word = _WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | cut[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | cut[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        words = word_hashes(data, s, e)
        first = np.searchsorted(s, offsets)  # of each row, its first word
        full = np.zeros(max(0, len(words) - width + 1), "u8")
        for k in range(width):
            full += words[k : k + len(full)] * np.uint64(pow(_STEP, k + 1, 2**64))
        full = _mix(full + np.uint64(width))
        for r in range(rows):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= width:
                h = np.sort(full[a : b - width + 1])
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                yield h[new]
            elif b > a:
                h = np.zeros(1, "u8")
                for k in range(b - a):
                    h += words[a + k : a + k + 1] * np.uint64(pow(_STEP, k + 1, 2**64))
                yield _mix(h + np.uint64(b - a))
            else:
                yield np.zeros(0, "u8")


def _node(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Size and digest of each document's set, and at the end this task's part of the frequency sketch, in 64 rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
    sketch = np.zeros(1 << bits, "i8")
    for batch in batches:
        ns, nodes, held, some = [], [], 0, []
        for h in shingle_sets(batch["text"], width):
            ns.append(len(h))
            nodes.append(_node(h) if len(h) else None)
            some.append(h)
            held += len(h)
            if held > 1 << 19:
                sketch += np.bincount(np.concatenate(some) >> np.uint64(64 - bits), minlength=1 << bits)
                some, held = [], 0
        if held:
            sketch += np.bincount(np.concatenate(some) >> np.uint64(64 - bits), minlength=1 << bits)
        none = pa.nulls(len(ns))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ns, pa.int64()), pa.array(nodes, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
    if sketch.any():
        parts = np.minimum(sketch, 2**31).astype("<u4").reshape(64, -1)
        none = pa.nulls(64)
        packed = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts]
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(64), pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def _add_sketches(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    total = np.zeros((1 << bits) // 64, "i8")
    for x in pdf["counts"]:
        total += np.frombuffer(pa.decompress(x, 4 * len(total), codec="zstd", asbytes=True), "<u4")
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, sketch, bits: int, fragments: int, hot: int, half: int) -> Iterator[pa.RecordBatch]:
    """The prefix of each set in the global order (rare first by the sketch, then by hash), packed by fragment of that order's
    hashes. A shingle that more than ``hot`` rows may hold is dealt over several fragments."""
    order, seen, held = sketch.value, set(), [[], [], [], []]
    size = 0

    def packed() -> pa.RecordBatch:
        token, node, pos, n = map(np.concatenate, held)
        parts = order[token >> np.uint64(64 - bits)] // np.uint32(hot) + np.uint32(1)
        fragment = (token + _mix(node.view("u8")) % parts) % np.uint64(fragments)
        at = np.argsort(fragment, kind="stable")
        token, node, pos, n, fragment = token[at], node[at], pos[at], n[at], fragment[at]
        cut = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        bounds = list(zip(cut, np.r_[cut[1:], len(token)]))
        columns = [[x[a:b].tobytes() for a, b in bounds] for x in (token, node, pos, n)]
        return pa.RecordBatch.from_arrays([pa.array(fragment[cut].astype("i8"), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["fragment", "token", "node", "pos", "n"])

    for batch in batches:
        for h in shingle_sets(batch["text"], width):
            if not len(h):
                continue
            node = np.frombuffer(_node(h)[8 * half : 8 * half + 8], "<i8")[0]
            if node in seen:
                continue
            if len(seen) > 500_000:  # only spares repeats: they are folded again later
                seen.clear()
            seen.add(node)
            keep = len(h) - -(-percent * len(h) // 100) + 1
            rarity = np.minimum(order[h >> np.uint64(64 - bits)], 2**bits - 1).astype("u8") << np.uint64(64 - bits)
            first = h[np.argsort(rarity | (h & np.uint64(2 ** (64 - bits) - 1)), kind="stable")[:keep]]
            for column, x in zip(held, (first, np.full(keep, node), np.arange(keep, dtype="<u4"), np.full(keep, len(h), "<u4"))):
                column.append(x)
            size += keep
            if size > 1_000_000:
                yield packed()
                held, size = [[], [], [], []], 0
    if size:
        yield packed()


SHARED = "a long, b long, na long, nb long, token long, node long, n long, pos long"


def _may_link(na, pa_, nb, pb, percent: int):
    """Whether two sets of these sizes may link whose first common shingle stands at these places."""
    bound = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (bound * (100 + percent) >= (na + nb) * percent)


def _shared(table: pa.Table, percent: int, sketch, bits: int, hot: int, few: int) -> pa.Table:
    """Of one fragment's shingles that several sets have in their prefix: all pairs that may link where these are at most
    ``few`` sets; where they are more, the pairs with two leaders of the shingle, and the entries themselves."""
    kinds = (("token", "u8"), ("node", "i8"), ("pos", "<u4"), ("n", "<u4"))
    token, node, pos, n = (np.frombuffer(b"".join(table[k].to_pylist()), kind) for k, kind in kinds)
    at = np.lexsort((node, token))
    at = at[np.r_[True, (token[at][1:] != token[at][:-1]) | (node[at][1:] != node[at][:-1])]] if len(at) else at
    token, node, pos, n = token[at], node[at], pos[at].astype("i8"), n[at].astype("i8")
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    sizes = np.diff(np.r_[start, len(token)])
    m = np.repeat(sizes, sizes)
    split = sketch.value[token >> np.uint64(64 - bits)] >= hot
    left, right = [], []
    for d in range(1, few):
        i = np.flatnonzero((token[d:] == token[:-d]) & (m[d:] <= few) & ~split[d:])
        left.append(i)
        right.append(i + d)
    large = (m > few) | split
    group = np.repeat(np.arange(len(start)), sizes)
    for order in (np.lexsort((node, pos, group)), np.lexsort((_mix(node.view("u8")), group))):
        lead = np.repeat(order[start], sizes)
        i = np.flatnonzero(large & (lead != np.arange(len(token))))
        left.append(lead[i])
        right.append(i)
    left, right = (np.concatenate(x).astype(int) for x in (left, right))
    ok = _may_link(n[left], pos[left], n[right], pos[right], percent)
    left, right = left[ok], right[ok]
    turn = node[left] > node[right]
    left, right = np.where(turn, right, left), np.where(turn, left, right)
    if len(left):
        by = np.lexsort((node[right], node[left]))
        left, right = left[by], right[by]
        new = np.r_[True, (node[left][1:] != node[left][:-1]) | (node[right][1:] != node[right][:-1])]
        left, right = left[new], right[new]
    e = np.flatnonzero(large)
    none, no = pa.nulls(len(e)).cast(pa.int64()), pa.nulls(len(left)).cast(pa.int64())
    both = lambda x, y: pa.chunked_array([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x, pa.array(y, pa.int64()) if isinstance(y, np.ndarray) else y])
    give_back()
    columns = [both(node[left], none), both(node[right], none), both(n[left], none), both(n[right], none), both(no, token[e].view("i8")), both(no, node[e]), both(no, n[e]), both(no, pos[e])]
    return pa.table(columns, names=[x.split()[0] for x in SHARED.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch], width: int, fragments: int, half: int) -> Iterator[pa.RecordBatch]:
    """Each set cut by fragments of the hash range."""
    edges = (np.arange(1, fragments, dtype="u8") * np.uint64(2**64 // fragments)).astype("u8")
    for batch in batches:
        nodes, parts, values = [], [], []
        for h in shingle_sets(batch["text"], width):
            if not len(h):
                continue
            node = int(np.frombuffer(_node(h)[8 * half : 8 * half + 8], "<i8")[0])
            for k, part in enumerate(np.split(h.view("i8"), np.searchsorted(h, edges))):
                if len(part):
                    nodes.append(node)
                    parts.append(k)
                    values.append(part)
        lengths = np.cumsum([0, *map(len, values)])
        flat = pa.array(np.concatenate(values) if values else np.zeros(0, "i8"), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)], names=["node", "fragment", "segment"])


def overlaps(pairs: DataFrame, segments: DataFrame, chunk: int = 256, broadcast_rows: int = 500_000) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps counted fragment by fragment and summed per pair.

    A set that is in very many pairs (over a thousandth of them, so at most 1,000 sets) is copied to several chunks of
    its partners, so that none of the joins has a hot key. Up to ``broadcast_rows`` pairs go to the segments, which then
    are shuffled once instead of twice.
    """
    total = pairs.count()
    many = F.when(F.col("c") > max(chunk, total // 1000), F.ceil(F.col("c") / chunk)).otherwise(1).cast("long")
    tops = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", many.alias("chunks")), "tops")
    members = lookup(pairs, tops, "a", broadcast_rows).withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks")).drop("chunks")
    heads = lookup(segments.withColumnRenamed("node", "a"), tops, "a", broadcast_rows).where("chunks is not null")
    heads = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks").withColumnRenamed("segment", "other")
    members = F.broadcast(members) if total <= broadcast_rows else members
    both = segments.withColumnRenamed("node", "b").join(members, "b").join(heads, ["a", "chunk", "fragment"])
    return both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("segment", "other"))).alias("overlap"))


BLOCK = "block long, fragment int, nodes binary, sizes binary, lengths binary, segments binary"


def _block(table: pa.Table) -> pa.Table:
    """One fragment of one block of sets, packed; sets that are alike compress to little more than one."""
    rows = sorted(zip(table["node"].to_pylist(), table["n"].to_pylist(), table["segment"]), key=lambda r: r[0])
    parts = [r[2].values.to_numpy() for r in rows]
    raw = np.concatenate(parts).astype("<i8").tobytes()
    packed = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
    arrays = (np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"), np.array([len(x) for x in parts], "<i8"))
    return pa.table({"block": table["block"].slice(0, 1), "fragment": table["fragment"].slice(0, 1), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("nodes", "sizes", "lengths"), arrays)}, "segments": pa.array([packed], pa.binary())})


PARTIAL = "a long, b long, left_nodes binary, left_sizes binary, right_nodes binary, right_sizes binary, counts binary"


def _partial(batches: Iterator[pa.RecordBatch], step: int = 4096) -> Iterator[pa.RecordBatch]:
    """Overlaps of two blocks within one fragment, counted as a product of incidence matrices over the shingles both hold."""
    fields = [x.split() for x in PARTIAL.split(", ")]
    schema = pa.schema([(k, pa.int64() if kind == "long" else pa.binary()) for k, kind in fields])
    for batch in batches:
        for n in range(batch.num_rows):
            r = batch.slice(n, 1).to_pylist()[0]
            values, rows = [], []
            for side in ("left", "right"):
                packed, lengths = r[f"{side}_segments"], np.frombuffer(r[f"{side}_lengths"], "<i8")
                values.append(np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), "<i8"))
                rows.append(np.repeat(np.arange(len(lengths)), lengths))
            common = np.intersect1d(*map(np.unique, values))
            if not len(common):
                continue
            sides = []
            for v, at in zip(values, rows):
                place = np.minimum(np.searchsorted(common, v), len(common) - 1)
                hit = common[place] == v
                order = np.argsort(place[hit], kind="stable")
                sides.append((place[hit][order], at[hit][order]))
            height, width = (len(r[f"{side}_lengths"]) // 8 for side in ("left", "right"))
            counts = np.zeros((height, width), "f4")
            for first in range(0, len(common), step):
                pair = []
                for (place, at), many in zip(sides, (height, width)):
                    x, y = np.searchsorted(place, (first, first + step))
                    held = np.zeros((min(step, len(common) - first), many), "f4")
                    held[place[x:y] - first, at[x:y]] = 1
                    pair.append(held)
                counts += pair[0].T @ pair[1]
            made = {"a": r["a"], "b": r["b"], **{f"{side}_{k}": r[f"{side}_{k}"] for side in ("left", "right") for k in ("nodes", "sizes")}, "counts": pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)}
            yield pa.RecordBatch.from_pylist([made], schema=schema)


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """The partial overlaps of a pair of blocks summed per pair of sets; of each set with a link, the smallest it leads to here."""
    rows = table.to_pylist()
    ids, sizes = {}, {}
    for side in ("left", "right"):
        nodes = np.concatenate([np.frombuffer(r[f"{side}_nodes"], "<i8") for r in rows])
        ids[side], first = np.unique(nodes, return_index=True)
        sizes[side] = np.concatenate([np.frombuffer(r[f"{side}_sizes"], "<i8") for r in rows])[first]
    total = np.zeros((len(ids["left"]), len(ids["right"])), "i8")
    for r in rows:
        i, j = (np.searchsorted(ids[side], np.frombuffer(r[f"{side}_nodes"], "<i8")) for side in ("left", "right"))
        part = np.frombuffer(pa.decompress(r["counts"], 4 * len(i) * len(j), codec="zstd", asbytes=True), "<u4").reshape(len(i), len(j))
        total[np.ix_(i, j)] += part
    i, j = np.nonzero(total * (100 + percent) >= (sizes["left"][:, None] + sizes["right"][None]) * percent)
    every = np.unique(np.concatenate([ids["left"], ids["right"]]))
    i, j = np.searchsorted(every, ids["left"][i]), np.searchsorted(every, ids["right"][j])
    label = np.arange(len(every))
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(every)))
    return pa.table({"a": pa.array(every[label[moved]], pa.int64()), "b": pa.array(every[moved], pa.int64())})


def block_links(entries: DataFrame, segments, labels: DataFrame | None, percent: int, block_sets: int, block_shingles: int = 2_000_000) -> DataFrame | None:
    """Links among the sets that share a common shingle of ``entries`` and are still in different components, or None.

    Every set goes to one block: by its most common shingle, by size, by component where that holds a good part of them, and
    by hash. Two blocks meet once if under any shingle a pair of theirs may link; then their overlaps are counted
    fragment by fragment and summed. A group of m sets makes (m / block_sets)**2 rows at most, and no pairs. ``segments`` gives
    the segments of the sets asked for.
    """
    current = entries.withColumn("comp", F.col("node")) if labels is None else lookup(entries, labels, "node").withColumn("comp", F.coalesce("comp", "node"))
    current = stage(current, "current")
    open_ = current.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("token", "m")
    current = stage(lookup(current, stage(open_, "open"), "token").where("m is not null"), "current")
    if not current.take(1):
        return None
    nodes = current.groupBy("node").agg(F.max(F.struct("m", "token"))["token"].alias("key"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    nodes = stage(nodes.withColumn("group", F.struct("key", F.floor(F.log("n") / math.log(1.1)).alias("band"))), "nodes")
    room = F.greatest(F.lit(1), F.least(F.lit(block_sets), F.floor(F.lit(block_shingles) / F.max("n")))).cast("long")
    own = nodes.groupBy(F.struct("group", "comp").alias("part")).agg(F.count(F.lit(1)).alias("c"), room.alias("room")).where("c * 2 >= room and c > 8").select("part", F.lit(True).alias("apart"))
    nodes = lookup(nodes.withColumn("part", F.struct("group", "comp")), stage(own, "own"), "part")
    nodes = stage(nodes.withColumn("group", F.struct("group", F.when(F.col("apart"), F.col("comp")).alias("comp"))).select("node", "n", "comp", "group"), "nodes")
    chunks = nodes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / room).alias("chunks"))
    members = lookup(nodes, stage(chunks, "chunks"), "group")
    members = stage(members.select("node", "n", "comp", F.xxhash64("group", F.pmod(F.xxhash64("node"), "chunks")).alias("block")), "members")

    left = F.col("n") - F.col("pos") - 1
    present = lookup(current.select("token", "node", "n", "pos", "comp"), members.select("node", "block"), "node")
    present = stage(present.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(left).alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "present")
    side = lambda k: present.select("token", F.struct("block", "least", "most", "rest", "lo", "hi").alias(k))
    both = side("x").join(side("y"), "token").where("x.block <= y.block")
    near = f"x.most * 100 >= y.least * {percent} and y.most * 100 >= x.least * {percent} and (1 + least(x.rest, y.rest)) * {100 + percent} >= (x.least + y.least) * {percent}"
    both = both.where(near).where("x.lo < x.hi or y.lo < y.hi or x.lo <> y.lo")
    met = stage(both.select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct(), "block-pairs")
    used = met.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    needed = stage(lookup(members, stage(used.withColumn("used", F.lit(True)), "used"), "block").where("used").select("node", "n", "block"), "needed")
    packed = needed.join(segments(needed.select("node")), "node").select("block", "fragment", "node", "n", "segment")
    packed = stage(packed.groupBy("block", "fragment").applyInArrow(_block, BLOCK), "blocks")
    names = ("nodes", "sizes", "lengths", "segments")
    sides = [packed.select(F.col("block").alias(k), "fragment", *[F.col(c).alias(f"{name}_{c}") for c in names]) for k, name in (("a", "left"), ("b", "right"))]
    partial = met.join(sides[0], "a").join(sides[1], ["b", "fragment"]).select("a", "b", *[f"{name}_{c}" for name in ("left", "right") for c in names]).mapInArrow(tidy(_partial), PARTIAL)
    return stage(partial.groupBy("a", "b").applyInArrow(lambda t: _linked(t, percent), "a long, b long"), "block-links")


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", fragment_rows: int = 1_000_000, few: int = 8, block_sets: int = 256, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id under links of Jaccard similarity >= percent / 100.

    Equal sets are one node. The global order of shingles is rare first by a hashed count sketch (of bounded size; any fixed
    order gives the same links), then by hash. Linked sets share a shingle within the first n - ceil(t n) + 1 of both. The
    prefixes are cut into fragments by hash; each fragment finds its shingles that several nodes hold. Of up to ``few`` nodes
    all pairs that pass the length and position bounds are verified, of more only those with two leaders; overlaps are counted
    per vertical fragment and summed per pair. What then is in different components under one shingle is compared block by
    block (see ``block_links``), again fragment by fragment; pairs inside a component need no test, as only components are
    asked for.

    A text of under ``width`` words is one shingle; null texts and texts without words have none and link with nothing.
    Repeated rows are equal sets, rows without an id link like others. Sets are told apart by 128-bit digests; ids of 64 bits
    stand for them once these are seen to differ. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = min(24, max(BITS, math.ceil(math.log2(max(1, texts.count()))) + 2))
    first = stage(texts.mapInArrow(tidy(lambda it: _sets(it, width, bits)), "doc_id long, n long, node binary, part int, counts binary"), "sets")
    sets = first.where("part is null").select("doc_id", "n", "node")
    parts = first.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(lambda p: _add_sketches(p, bits), "part int, counts binary").collect()
    sketch = np.zeros((64, (1 << bits) // 64), "u4")
    for r in parts:
        sketch[r["part"]] = np.frombuffer(r["counts"], "<u4")
    shared = spark.sparkContext.broadcast(sketch.reshape(-1))
    nodes = stage(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "nodes")
    for half in (0, 1):
        # eight bytes of the digest, little-endian, as a signed number
        flip = F.concat(*[F.substring(F.hex("node"), 15 + 16 * half - 2 * k, 2) for k in range(8)])
        ids = F.shiftleft(F.conv(F.substring(flip, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(flip, 9, 8), 16, 10).cast("long"))
        named = nodes.withColumn("id", ids)
        if not named.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").take(1):
            break
    else:
        raise ValueError("two sets share both halves of their digests")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    fragments = max(64, total * (100 - percent) // 100 // fragment_rows)
    hot = max(1000, fragment_rows)
    packed = texts.mapInArrow(tidy(lambda it: _prefixes(it, width, percent, shared, bits, fragments, hot, half)), "fragment long, token binary, node binary, pos binary, n binary")
    met = stage(packed.groupBy("fragment").applyInArrow(lambda t: _shared(t, percent, shared, bits, hot, few), SHARED), "shared")
    reps = named.select(F.col("id").alias("node"), F.coalesce("rep", F.lit(-(2**63))).alias("doc_id"))
    some: dict[str, DataFrame] = {}

    def segments(wanted: DataFrame) -> DataFrame:
        """The segments of the wanted nodes; texts are read again only for those that no call before has asked for."""
        wanted = stage(wanted.distinct() if not some else wanted.distinct().join(some["have"], "node", "left_anti"), "wanted")
        picks = stage(reps.join(wanted, "node", "left_semi").select("doc_id").distinct(), "wanted-ids")
        picks = F.broadcast(picks) if picks.count() <= broadcast_rows else picks
        picked = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(picks, "doc_id", "left_semi")
        new = stage(picked.mapInArrow(tidy(lambda it: _segments(it, width, 8, half)), "node long, fragment int, segment array<long>"), "segments")
        if new.groupBy("node", "fragment").agg(F.count(F.lit(1)).alias("c")).where("c > 1").take(1):  # ids that are repeated or missing
            new = stage(new.dropDuplicates(["node", "fragment"]), "segments")
        some["have"], some["all"] = (wanted, new) if not some else (some["have"].unionByName(wanted), some["all"].unionByName(new))
        return some["all"]

    pairs = stage(met.where("a is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "pairs")
    links, labels = None, None
    if pairs.take(1):
        found = overlaps(pairs, segments(pairs.select(F.explode(F.array("a", "b")).alias("node"))), broadcast_rows=broadcast_rows).where(F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
        links = stage(found.select("a", "b"), "found")
        labels = components(links)
    entries = met.where("token is not null").select("token", "node", "n", "pos")
    more = block_links(entries, segments, labels, percent, block_sets)
    if more is not None:
        links = more if links is None else links.unionByName(more)
        labels = components(links)

    known = named.select("node", "id", "rep")
    if labels is not None:
        known = known.join(labels.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
        known = lookup(known, least, "comp").select("node", "component_id")
    else:
        known = known.select("node", F.col("rep").alias("component_id"))
    out = lookup(sets, stage(known, "known"), "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
