"""Removal of passages that an earlier document holds too: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import lookup, stage, tidy
from .ngram_join import _STEP, _mix, _power

#: Bytes of text whose words are lists at one time, and runs that one packet holds at least.
PART, PACKET = 4_000_000, 250_000
#: Bytes up to which answers, runs or spans go to every executor; beyond that they are shuffled to the rows that need them.
BROADCAST_BYTES = 32_000_000
#: A null id is the largest of all, so that it takes nothing from others.
LAST = 2**63 - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(data: bytes, limit: int = PART) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in lists, cut at white space after every ``limit`` bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + limit) if at + limit < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()  # bytes split at exactly these six characters
        at = end


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts, and how many words each has."""
    hashes, sizes = [], np.zeros(len(texts), "i8")
    for i, text in enumerate(texts):
        for words in parts((text or "").encode("utf-8", "surrogatepass")):
            sizes[i] += len(words)
            hashes.append(np.fromiter(map(xxh3_64_intdigest, words), "u8", len(words)))
    return np.concatenate(hashes) if hashes else np.zeros(0, "u8"), sizes


class Rolling:
    """Hashes of any stretch of words by differences of running sums; two independent streams."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power(len(words) + 1)
        self.sums = []
        for stream in (words, _mix(words + np.uint64(_STEP))):
            sums = np.zeros(len(words) + 1, "u8")
            np.cumsum(stream * up[: len(words)], out=sums[1:])
            self.sums.append(sums)

    def of(self, stream: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stream][end] - self.sums[stream][start]) * self.down[start])


def runs(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The windows of all texts in runs: (text, start in the text, windows, anchor, digest), a row for each run.

    A window's anchor is the stretch of half its words with the least hash, leftmost of equals: equal windows have equal
    anchors at equal places, so an anchor occurs at least as often as each of its windows. Neighbouring windows with the
    same anchor occurrence are one run, some 13 windows of 50 words. The digest tells the words of a run and its anchor's place.
    """
    gram = window // 2
    first = np.cumsum(sizes) - sizes
    if len(words) < window:
        return tuple(np.zeros(0, k) for k in ("i8", "i8", "i8", "u8", "u8"))
    roll = Rolling(words)
    at = np.arange(len(words) - gram + 1)
    value = roll.of(0, at, at + gram)
    best, width, wide = at, 1, window - gram + 1
    while width < wide:
        step = min(width, wide - width)
        left, right = best[: len(best) - step], best[step:]
        best, width = np.where(value[right] < value[left], right, left), width + step
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(text[: len(best)] == text[window - 1 :])
    anchor = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.r_[head, len(start)])
    begin, anchor = start[head], anchor[head]
    place = (anchor - begin).astype("u8") * np.uint64(1024) + n.astype("u8")
    return text[begin], begin - first[text[begin]], n, value[anchor], _mix(roll.of(1, begin, begin + n + window - 1) + place * np.uint64(_STEP))


RUNS = "packet long, ids binary, proofs binary, sizes binary, starts binary, counts binary, anchors binary, digests binary"
_FIELDS = (("ids", "i8"), ("proofs", "i8"), ("sizes", "i8"), ("starts", "i4"), ("counts", "u2"), ("anchors", "u8"), ("digests", "u8"))


def _packets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Packed runs of some documents at a time; documents without a window are left out."""
    part, number, held, some = TaskContext.get().partitionId(), 0, [], 0

    def packet():
        columns = [np.concatenate([h[k] for h in held]).astype(kind) for k, (_, kind) in enumerate(_FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number])] + [pa.array([c.tobytes()], pa.binary()) for c in columns], names=["packet"] + [n for n, _ in _FIELDS])

    for batch in batches:
        for rows in _slices(batch):
            words, sizes = _words(rows["text"].to_pylist())
            text, start, n, anchor, digest = runs(words, sizes, window)
            if len(text):
                each = np.bincount(text, minlength=len(sizes))
                has = each > 0
                held.append((rows["rank"].to_numpy()[has], rows["proof"].to_numpy()[has], each[has], start, n, anchor, digest))
                some += len(text)
            if some >= PACKET:
                yield packet()
                held, some, number = [], 0, number + 1
    if held:
        yield packet()


def _slices(batch: pa.RecordBatch, limit: int = PART) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _keys(anchors: bytes, bits: int) -> np.ndarray:
    """What the sketch counts, slice by slice: of each anchor the slice (its first bits) and 32 bits more."""
    return np.frombuffer(anchors, "u8") >> np.uint64(32 - bits)


def _sketch(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A packet's own sketch, cut into slices and sparse: its distinct keys and how often it has each (255 stands for more)."""
    for batch in batches:
        for packet, anchors in zip(batch["packet"].to_pylist(), batch["anchors"].to_pylist()):
            keys, n = np.unique(_keys(anchors, bits), return_counts=True)
            cut = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype="u8"))
            n = np.minimum(n, 255).astype("u1")
            rows = [(k, packet, keys[x:y].astype("u4").tobytes(), n[x:y].tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["slice", "packet", "keys", "counts"])


def count_min(keys: np.ndarray, counts: np.ndarray, depth: int = 2) -> np.ndarray:
    """For each key the least of its ``depth`` counters after all were added: never below its true count."""
    width, least = 1 << max(4, math.ceil(math.log2(max(len(keys), 1))) + 1), None
    for row in range(depth):
        cell = (_mix(keys.astype("u8") + np.uint64((row + 1) * _STEP % 2**64)) & np.uint64(width - 1)).astype("i8")
        counters = np.bincount(cell, weights=counts, minlength=width)
        least = counters[cell] if least is None else np.minimum(least, counters[cell])
    return least


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices, in order: the packets' sketches added up, then for every packet one bit a key, whether it may be repeated."""

    def answer(held):
        keys = [np.frombuffer(x, "u4") for _, x, _ in held]
        seen = count_min(np.concatenate(keys), np.concatenate([np.frombuffer(x, "u1") for _, _, x in held]).astype("f8")) >= 2
        bits = [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([now] * len(held), pa.int32()), pa.array([p for p, _, _ in held], pa.int64()), pa.array(bits, pa.binary())], names=["slice", "packet", "bits"])

    now, held = None, []
    for batch in batches:
        for k, packet, keys, counts in zip(*(batch[c].to_pylist() for c in ("slice", "packet", "keys", "counts"))):
            if k != now and held:
                yield answer(held)
                held = []
            now = k
            held.append((packet, keys, counts))
    if held:
        yield answer(held)


def _flagged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The runs whose anchor may be repeated, one row each."""
    for batch in batches:
        for row in batch.to_pylist():
            key = _keys(row["anchors"], bits)
            distinct = np.unique(key)
            each = np.bincount((distinct >> np.uint64(32)).astype("i8"), minlength=1 << bits)
            seen = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], "u1"), count=each[x["slice"]]) for x in sorted(row["answers"], key=lambda x: x["slice"])])
            ids, proofs, sizes, starts, counts, anchors, digests = (np.frombuffer(row[n], kind) for n, kind in _FIELDS)
            on = np.flatnonzero(seen[np.searchsorted(distinct, key)])
            doc = np.repeat(np.arange(len(ids)), sizes)[on]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[on].view("i8"), digests[on].view("i8"), ids[doc], proofs[doc], starts[on].astype("i4"), counts[on].astype("i4"))], names=["anchor", "digest", "rank", "proof", "start", "n"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of the runs asked for, with its own hash."""
    for batch in batches:
        for rows in _slices(batch):
            words, sizes = _words(rows["text"].to_pylist())
            roll, first = Rolling(words), np.cumsum(sizes) - sizes
            asked = rows["asked"]
            doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            start, n, anchor = (pc.struct_field(pc.list_flatten(asked), k).to_numpy() for k in ("start", "n", "anchor"))
            each = np.repeat(np.arange(len(n)), n)
            place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            at = place + first[doc[each]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[each], roll.of(1, at, at + window).view("i8"), rows["rank"].to_numpy()[doc[each]], rows["proof"].to_numpy()[doc[each]], place.astype("i4"))], names=["anchor", "digest", "rank", "proof", "start"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by document and start, joined where they touch: one row a document with lists of starts and ends."""
    last, starts, ends = None, [], []

    def row(out):
        out.append((*last, starts, ends))

    for batch in batches:
        out: list[tuple] = []
        for rank, proof, start, end in zip(*(batch[c].to_pylist() for c in ("rank", "proof", "start", "end"))):
            if (rank, proof) != last:
                if last is not None:
                    row(out)
                last, starts, ends = (rank, proof), [start], [end]
            elif start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        if out:
            yield _merged(out)
    if last is not None:
        yield _merged([(*last, starts, ends)])


def _merged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["rank", "proof", "starts", "ends"])


def _beside(docs: DataFrame, table: DataFrame, size: int, how: str) -> DataFrame:
    """``docs`` joined to a table by document, which is broadcast up to ``BROADCAST_BYTES`` and shuffled beyond."""
    return docs.join(F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge"), ["rank", "proof"], how)


def repeated_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", slice_runs: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Two tables: (rank, proof, doc_id, text) of all rows, and (rank, proof, starts, ends), the words to remove by document.

    1. Every task hashes the words of its documents, cuts their windows into ``runs`` and makes a count-min sketch of the
       anchors. The sketches are cut into slices of the hash space and added up slice by slice, so none is ever whole in one
       task and the number of slices follows the data. Each packet of runs learns, one bit an anchor, which may be repeated.
    2. Runs that may be are grouped exactly by anchor and digest: where an earlier document has the run, all its windows go.
       Where an anchor has several different runs, the windows of each one's first document are grouped one by one.

    Sketches only overestimate, so no repeat is lost; both groupings tell contents apart by 128 bits of hash. No window,
    document or group is gathered: a group is its least id. Equal rows (id and text) share one answer.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(text).alias("proof"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    packets = stage(rows.select("rank", "proof", "text").mapInArrow(tidy(lambda it: _packets(it, window)), RUNS), "runs")
    total = packets.agg(F.sum(F.octet_length("anchors") / 8)).first()[0] or 0
    bits = min(31, max(6, math.ceil(math.log2(max(total / slice_runs, 1)))))
    sketches = packets.select("packet", "anchors").mapInArrow(lambda it: _sketch(it, bits), "slice int, packet long, keys binary, counts binary")
    merged = sketches.repartitionById(1 << bits, F.col("slice")).sortWithinPartitions("slice").mapInArrow(tidy(_merge), "slice int, packet long, bits binary")
    answers = merged.groupBy("packet").agg(F.collect_list(F.struct("slice", "bits")).alias("answers"))
    answered = packets.join(F.broadcast(answers) if total / 8 <= BROADCAST_BYTES else answers, "packet")
    found = stage(answered.mapInArrow(tidy(lambda it: _flagged(it, bits)), "anchor long, digest long, rank long, proof long, start int, n int"), "found")

    kinds = stage(found.groupBy("anchor", "digest").agg(F.min("rank").alias("least"), F.max("rank").alias("most")), "kinds")
    several = kinds.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("mixed"), F.max(F.col("most") > F.col("least")).alias("copied"))
    # anchors that one run alone has, false alarms of the sketch among them, end here
    known = lookup(kinds, stage(several.where("mixed or copied").select("anchor", "mixed"), "several"), "anchor").where("mixed is not null")
    judged = found.join(known.where("mixed or most > least"), ["anchor", "digest"]).select("anchor", "rank", "proof", "start", "n", (F.col("rank") > F.col("least")).alias("copy"), "mixed")
    judged = stage(judged, "judged")
    copies = judged.where("copy").select("rank", "proof", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    asked = judged.where("mixed and not copy").groupBy("rank", "proof").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("asked"))
    asked = stage(asked, "asked")
    size = (asked.agg(F.sum(F.size("asked") * 24 + 32)).first()[0] or 0)
    one = rows.select("rank", "proof", "text")
    windows = stage(_beside(one, asked, size, "inner").mapInArrow(tidy(lambda it: _windows(it, window)), "anchor long, digest long, rank long, proof long, start int"), "windows")
    least = windows.groupBy("anchor", "digest").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("most > least").drop("most")
    single = windows.join(least, ["anchor", "digest"]).where("rank > least").select("rank", "proof", "start", (F.col("start") + window).alias("end"))
    spans = copies.unionByName(single).repartition("rank", "proof").sortWithinPartitions("rank", "proof", "start").mapInArrow(_union, "rank long, proof long, starts array<int>, ends array<int>")
    return rows, stage(spans, "spans")


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, starts, ends in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "starts", "ends"))):
            digest, n, gone, begun, spans = hashlib.sha256(), 0, 0, False, list(zip(starts or (), ends or ()))[::-1]
            for words in parts(text.encode("utf-8", "surrogatepass")):
                kept, at = [], 0
                while spans and spans[-1][0] < n + len(words):
                    start, end = spans.pop()
                    kept += words[at : max(at, start - n)]
                    gone += min(end, n + len(words)) - max(start, n)
                    at = min(end - n, len(words))
                    if end > n + len(words):  # it goes on in the next part
                        spans.append((n + len(words), end))
                        break
                kept += words[at:]
                n += len(words)
                if kept:
                    digest.update(b" " * begun + b" ".join(kept))
                    begun = True
            out.append((doc, n, gone, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (the words that stay, joined by one space).

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. A null text has no words; texts with fewer words than a window keep all. Rows of one id take nothing
    from each other; a null id is larger than all others. Long texts are read in parts. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows, spans = repeated_words(docs, window, **options)
    size = spans.agg(F.sum(F.size("starts") * 8 + 64)).first()[0] or 0
    return _beside(rows, spans, size, "left").select("doc_id", "text", "starts", "ends").mapInArrow(tidy(_keep), KEPT)


def op12_substring_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
s AS (SELECT r, doc_id, i, word, CASE WHEN i + 50 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS win FROM x),
f AS (SELECT win, min(doc_id) AS least FROM s WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT s.*, coalesce(f.least < coalesce(s.doc_id, 9223372036854775807), false) AS starts FROM s LEFT JOIN f USING (win)),
c AS (SELECT r, i, word, bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
