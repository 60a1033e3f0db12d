"""Removal of long repeated byte strings: anchored shards, merged by interleave refinement of a Burrows-Wheeler order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, stage
from .exact_dedup import digests, merge_runs
from .ngram_join import _mix, _power, slices

#: Bytes of an anchor. A repeated string of ``length`` bytes has an anchor: its least-hashed part of this size, the first of equals.
GRAM = 48
_VALUE = np.random.default_rng(23).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
#: In the key by which anchors are chosen, the low bits hold the place.
_PLACE = np.uint64(2**28 - 1)


#: Bytes of one text that are laid out at once; a longer one is cut, with an overlap that keeps every window whole.
PART = 1 << 22


def parts(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Slices of a string column as (first row, bytes, offsets, bytes of the row before them); every window lies in exactly one."""
    for row, data, offsets in slices(texts):
        if len(data) <= PART + length:
            yield row, data, offsets, 0
            continue
        for start in range(0, len(data) - length + 1, PART):
            own = data[start : start + PART + length - 1]
            yield row, own, np.array([0, len(own)]), start


def _spread(gram: np.ndarray) -> np.ndarray:
    """Anchor hashes are the least of many: mixed once more they spread over fragments, bits and buckets evenly."""
    return _mix(gram ^ np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Over one slice of documents: (hash, place, first, last window start) of each anchor, and prefix sums for further hashes.

    Windows of ``length`` bytes that share an anchor occurrence are a run of starts. The choice depends on the window's bytes
    alone, so equal windows have equal anchors at equal distances.
    """
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    starts = len(data) - length + 1
    none = np.zeros(0, int)
    if starts <= 0:
        return np.zeros(0, "u8"), none, none, none, sums, down
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype="u8")
    many, span, least = length - GRAM + 1, 1, key
    while span * 2 <= many:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:starts], least[many - span : many - span + starts])
    place = (least & _PLACE).astype(int)
    inside = np.zeros(len(data) + 1, "i4")
    sizes = np.diff(offsets)
    some = sizes >= length
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - length + 1, -1)
    valid = np.cumsum(inside)[:starts] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    # two documents side by side may have windows in a row, but never the same anchor place
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    at = place[first]
    return gram[at], at, first, last, sums, down


#: Packed text is compressed once more before it is shuffled: pieces of one anchor overlap and repeat one another.
_CODEC = "zstd"


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec=_CODEC, asbytes=True)


def _anchor_counts(batches: Iterator[pa.RecordBatch], length: int, fragments: int) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - fragments.bit_length() + 1)
    held, size = [], 0

    def packed():
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(hashes >> shift, np.arange(fragments + 1, dtype="u8"))
        keep = [k for k in range(fragments) if cut[k + 1] > cut[k]]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([hashes[cut[k] : cut[k + 1]].tobytes() for k in keep], pa.binary()), pa.array([n[cut[k] : cut[k + 1]].astype("u4").tobytes() for k in keep], pa.binary())], names=["fragment", "hashes", "counts"])

    for batch in batches:
        for _, data, offsets, _ in parts(batch["text"], length):
            h = _spread(anchors(data, offsets, length)[0])
            held.append(h)
            size += len(h)
            if size > 2_000_000:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


def _repeated(table: pa.Table, bits: int, fragments: int) -> pa.Table:
    """One fragment of anchors: a bitmap of those that occur twice, by leading bits, and how many occurrences they have."""
    hashes = np.concatenate([np.frombuffer(x, "u8") for x in table["hashes"].to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "u4") for x in table["counts"].to_pylist()])
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    total = np.add.reduceat(counts, first, dtype="i8")
    own = bits - (fragments.bit_length() - 1)
    at = ((hashes[first][total > 1] >> np.uint64(64 - bits)) & np.uint64(2**own - 1)).astype(int)
    bitmap = np.zeros(max(8, 2**own), bool)
    bitmap[at] = True
    return pa.table({"fragment": table["fragment"].slice(0, 1), "bitmap": pa.array([_squeeze(np.packbits(bitmap).tobytes())], pa.binary()), "n": pa.array([int(total[total > 1].sum())], pa.int64())})


PIECES = "bucket int, anchor binary, doc binary, proof binary, first binary, left binary, windows binary, settled binary, blob binary"


def _alike(data: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, at: np.ndarray, step: int = 4_000_000) -> np.ndarray:
    """Whether the pieces order[at] equal the ones before them in the order, byte by byte."""
    out = np.zeros(len(at), bool)
    x, y = order[at], order[at - 1]
    fit = np.flatnonzero(size[x] == size[y])
    ends = np.cumsum(size[x][fit])
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(step, ends[-1] + step, step)), len(fit)]) if len(fit) else []
    for a, b in zip(cuts, cuts[1:]):
        own = fit[a:b]
        n = size[x][own]
        begin = np.cumsum(n) - n
        step_in = np.arange(n.sum()) - np.repeat(begin, n)
        differ = data[np.repeat(first[x][own], n) + step_in] != data[np.repeat(first[y][own], n) + step_in]
        out[own] = ~np.logical_or.reduceat(differ, begin)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], length: int, bitmap, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The text around every repeated anchor, packed by bucket: all bytes of the windows that have it.

    Pieces equal byte by byte within a slice are sent once; what is repeated there already needs no answer and is sent as settled.
    """
    known = bitmap.value
    held: list[tuple] = []
    size = 0

    def packed():
        parts = [np.concatenate([h[k] for h in held]) for k in range(7)]
        blobs = np.concatenate([h[7] for h in held])
        bucket = (parts[0] % np.uint64(buckets)).astype(int)
        order = np.lexsort((parts[0], bucket))
        lengths = np.where(parts[6] == 2, 0, parts[5] + length - 1)
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
        rows = []
        for a, b in zip(cut, np.r_[cut[1:], len(order)]):
            own = order[a:b]
            n = lengths[own]
            at = np.repeat(begin[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            rows.append([int(bucket[own[0]]), *(p[own].tobytes() for p in parts), _squeeze(blobs[at].tobytes())])
        kinds = [pa.int32()] + [pa.binary()] * 8
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], names=["bucket", "anchor", "doc", "proof", "first", "left", "windows", "settled", "blob"])

    for batch in batches:
        ids, proofs = batch["doc_id"].to_numpy(zero_copy_only=False), batch["proof"].to_numpy()
        for row, data, offsets, shift in parts(batch["text"], length):
            gram, at, first, last, sums, down = anchors(data, offsets, length)
            gram = _spread(gram)
            bit = gram >> np.uint64(64 - bits)
            keep = (known[(bit >> np.uint64(3)).astype(int)] >> (7 - (bit & np.uint64(7)).astype("u1"))) & 1 > 0
            gram, at, first, last = gram[keep], at[keep], first[keep], last[keep]
            if not len(gram):
                continue
            end = last + length
            content = _mix((sums[end] - sums[first]) * down[first] + (at - first).astype("u8") * np.uint64(0x9E3779B97F4A7C15) + (end - first).astype("u8"))
            order = np.lexsort((content, gram))
            same = np.zeros(len(order), bool)
            same[1:] = (gram[order][1:] == gram[order][:-1]) & (content[order][1:] == content[order][:-1])
            same[np.flatnonzero(same)] = _alike(data, first, end - first, order, np.flatnonzero(same))
            lead = order[~same]
            count = np.diff(np.r_[np.flatnonzero(~same), len(order)])
            double = np.zeros(len(order), bool)
            double[order] = np.repeat(count > 1, count)
            doc = np.searchsorted(offsets, at, side="right") - 1
            # 0: asks for an answer, 1: settled, 2: no piece, only the note that these windows are repeated
            note = np.flatnonzero(double)
            use, state = np.r_[lead, note], np.r_[double[lead].astype("u1"), np.full(len(note), 2, "u1")]
            n = end[lead] - first[lead]
            take = np.repeat(first[lead] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            d = doc[use]
            held.append((gram[use], ids[row + d].astype("i8"), proofs[row + d].astype("i8"), first[use] - offsets[d] + shift, at[use] - first[use], last[use] - first[use] + 1, state, data[take]))
            size += len(take) + 48 * len(use)
            if size > 24_000_000:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def refine(blob: np.ndarray, offset: np.ndarray, left: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first, last) of window starts, counted from the piece's start, that another piece of the group repeats.

    The pieces of a group are strings laid out so that their common anchor stands in one column; as they come from the
    shards they are interleaved in any order. Column by column the interleave is refined: a stable partition by the next
    byte keeps the rows in the order of their reversed prefixes (the positional Burrows-Wheeler transform), and no suffix is
    sorted again. Beside it goes the column from which a row agrees with the row before it, the largest over the rows that
    a partition moves away in between. Rows whose agreement reaches back over ``length`` columns form a repeated interval.
    ``group`` must ascend. Rows that no longer can take part in an interval leave.
    """
    rows = len(offset)
    size = windows + length - 1
    final = windows - 1 - left  # column of the last window's start
    enters = np.argsort(-left, kind="stable")
    enter_at = np.searchsorted(-left[enters], np.arange(-left.max(), 2))
    low = -int(left.max())
    order, div = np.zeros(0, int), np.zeros(0, int)
    start, seen = np.full(rows, -(10**9)), np.full(rows, -(10**9))
    out: list[tuple] = []
    base = offset + left
    ends = size - left
    for c in range(low, int(ends.max())):
        if c <= 0:
            fresh = enters[enter_at[c - low] : enter_at[c - low + 1]]
            if len(fresh):
                order, div = np.r_[order, np.sort(fresh)], np.r_[div, np.full(len(fresh), c)]
                by = np.argsort(group[order], kind="stable")
                order, div = order[by], div[by]
        if 0 <= c < GRAM - 1:
            continue  # the anchor: the same byte in every row
        stay = ends[order] > c
        if c % 8 == 0 and c > 0 and len(order):
            near = div.copy()
            near[:-1] = np.minimum(near[:-1], np.where(group[order[1:]] == group[order[:-1]], div[1:], 10**9))
            stay &= (final[order] > c) | (near <= final[order])
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept):
                div = np.maximum.reduceat(div[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
            else:
                div = div[:0]
            order = order[kept]
        if not len(order):
            if c > 0:
                break
            continue
        g = group[order]
        key = g * 256 + blob[base[order] + c]
        perm = np.argsort(key, kind="stable")
        ranked = key[perm]
        same = np.zeros(len(perm), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        merged = np.full(len(perm), c + 1)
        j = np.flatnonzero(same)
        q, p = perm[j - 1] + 1, perm[j]
        close = q == p
        merged[j[close]] = div[p[close]]
        far = ~close
        if far.any():
            ranges = np.stack([q[far], p[far] + 1], 1).ravel()
            merged[j[far]] = np.maximum.reduceat(np.r_[div, 0], ranges)[::2]
        order, div = order[perm], merged
        s = c - length + 1
        back = same & (div <= s)
        if back.any():
            hit = back.copy()
            hit[:-1] |= back[1:]
            r = order[hit]
            broken = r[seen[r] != c - 1]
            old = broken[seen[broken] > -(10**8)]
            out.append((old, start[old], seen[old]))
            start[broken] = c
            seen[r] = c
    old = np.flatnonzero(seen > -(10**8))
    out.append((old, start[old], seen[old]))
    row, first, last = (np.concatenate([o[k] for o in out]) for k in range(3))
    return row, first - length + 1 + left[row], last - length + 1 + left[row]


SPANS = "doc_id long, proof long, start long, stop long"


def _merge(table: pa.Table, length: int) -> pa.Table:
    """Repeated spans of the pieces in one bucket."""
    kinds = {"anchor": "u8", "doc": "i8", "proof": "i8", "first": "i8", "left": "i8", "windows": "i8", "settled": "u1"}
    p = {k: np.concatenate([np.frombuffer(x, kind) for x in table[k].to_pylist()]) for k, kind in kinds.items()}
    blob = np.concatenate([np.frombuffer(_expand(x), "u1") for x in table["blob"].to_pylist()])
    note = p["settled"] == 2
    docs, proofs, starts, stops = [p["doc"][note]], [p["proof"][note]], [p["first"][note]], [(p["first"] + p["windows"])[note] + length - 1]
    size = np.where(note, 0, p["windows"] + length - 1)
    offset = np.r_[0, np.cumsum(size)[:-1]]
    real = np.flatnonzero(~note)
    # a group: the same 48 bytes, not only the same hash of them
    a = p["anchor"][real]
    words = blob[(offset[real] + p["left"][real])[:, None] + np.arange(GRAM)].view("<u8") if len(real) else np.zeros((0, GRAM // 8), "<u8")
    order = np.lexsort((*words.T, a))
    real, a, words = real[order], a[order], words[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (words[1:] != words[:-1]).any(1)] if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(a) else np.zeros(0, bool)
    real, group = real[many], group[many]
    for part in np.array_split(np.arange(len(real)), max(1, len(real) // 60_000)):  # groups cut apart here are put together again
        if not len(part):
            continue
        if part[0] and group[part[0]] == group[part[0] - 1]:
            part = part[np.searchsorted(group[part], group[part[0]], side="right") :]
        if not len(part):
            continue
        part = np.arange(part[0], np.searchsorted(group, group[part[-1]], side="right"))
        own = real[part]
        row, first, last = refine(blob, offset[own], p["left"][own], p["windows"][own], group[part], length)
        row = own[row]
        ask = p["settled"][row] == 0
        row, first, last = row[ask], first[ask], last[ask]
        docs.append(p["doc"][row])
        proofs.append(p["proof"][row])
        starts.append(p["first"][row] + first)
        stops.append(p["first"][row] + last + length)
    return pa.table({"doc_id": pa.array(np.concatenate(docs), pa.int64()), "proof": pa.array(np.concatenate(proofs), pa.int64()), "start": pa.array(np.concatenate(starts), pa.int64()), "stop": pa.array(np.concatenate(stops), pa.int64())})


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 24_000_000, bits: int | None = None, fragment_anchors: int = 2_000_000) -> DataFrame:
    """Every row with its repeated byte spans: doc_id, text, spans (ascending, disjoint (start, stop) in UTF-8 bytes).

    A byte is repeated if a string of ``length`` bytes that covers it also starts elsewhere in the table, in the same text
    or in another; overlaps count and matches stay within a text. Texts that stand in several rows are repeated whole where
    they have ``length`` bytes, and only one row of them goes on. Of the rest, all anchors (see ``anchors``) are counted in
    fragments of the hash space. Those that occur twice set bits of a bitmap whose size follows the bytes (up to 2**30 bits, 128 MB);
    false alarms cost time, nothing else. Around every such anchor the tasks, as shards, send their pieces to buckets, where ``refine`` merges them.

    Null: an empty text. Texts under ``length`` bytes have no spans. Repeated rows are copies like any other. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = stage(digests(rows, F.col("text")), "digests")
    copies = stage(merge_runs(short).where("group_size > 1"), "copies").select("digest", "keep_id", "group_size")
    known = lookup(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), copies, "digest").withColumn("proof", F.xxhash64("text"))
    enough = F.octet_length("text") >= length
    first = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    texts = known.where(enough & first).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "proof", "text")

    # about two anchors in every length - GRAM bytes
    expected = 2 * (short.agg(F.sum("n_bytes")).first()[0] or 0) // max(1, length - GRAM) + 1
    fragments = max(64, 2 ** math.ceil(math.log2(expected / fragment_anchors)))
    bits = bits or min(30, max(20, math.ceil(math.log2(4 * expected))))
    bits = max(bits, int(math.log2(fragments)) + 3)
    counted = texts.select("text").mapInArrow(lambda it: _anchor_counts(it, length, fragments), "fragment int, hashes binary, counts binary")
    found = counted.groupBy("fragment").applyInArrow(lambda t: _repeated(t, bits, fragments), "fragment int, bitmap binary, n long").collect()
    bitmap = np.zeros((fragments, 2**bits // fragments // 8), "u1")
    for r in found:
        bitmap[r["fragment"]] = np.frombuffer(_expand(r["bitmap"]), "u1")
    occurrences = sum(r["n"] for r in found)
    shared = spark.sparkContext.broadcast(bitmap.reshape(-1))
    buckets = max(12, math.ceil(occurrences * (length + 180) / bucket_bytes))
    pieces = texts.mapInArrow(lambda it: _pieces(it, length, shared, bits, buckets), PIECES)
    spans = pieces.groupBy("bucket").applyInArrow(lambda t: _merge(t, length), SPANS)
    many = spans.groupBy("doc_id", "proof").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("raw"))
    join = F.aggregate("raw", F.array().cast("array<struct<start:bigint,stop:bigint>>"), lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x))))
    many = stage(many.select(F.struct("doc_id", "proof").alias("key"), join.alias("found")), "spans")
    out = lookup(known.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "proof")), many, "key")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return out.select("doc_id", "text", F.when(F.col("group_size").isNotNull() & enough, whole).otherwise(F.coalesce("found", none)).alias("spans"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, shas = [], [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            raw, at, kept = text.encode(), 0, hashlib.sha256()
            for s in spans:
                kept.update(raw[at : s["start"]])
                at = s["stop"]
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(s["stop"] - s["start"] for s in spans))
            runs.append(len(spans))
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op6_suffix_dedup(spark, sf_dir):
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
