"""Packing of tokenised documents into sequences by best-fit decreasing over a segment tree."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stage, tidy

#: Words whose ids a worker keeps; beyond that only the short ones stay, which are the frequent ones, so its memory is bounded.
KEPT_WORDS, SHORT = 300_000, 8
#: Letters and numerals below U+0180 in lower case, as the tokenizer's splitting pattern sees them.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿā-ž", "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
#: Characters for which lower-casing, composition and splitting go by character, so that white-space words can be told apart first.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e¡-įĲ-ňŊ-ž‐-‧‰-⁞€]*")


class WordIds:
    """Ids of the word-ending BPE vocabulary as little-endian bytes, word by word; other texts go to the tokenizer whole."""

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            ids = self._raw(" ".join(some))
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([len(_PIECE.findall(w)) for w in some])
            cuts, raw, begin = ends[last - 1].tolist(), ids.tobytes(), 0
            for word, cut in zip(some, cuts):
                self.known[word] = raw[begin : 4 * cut]
                begin = 4 * cut

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.lower().split() if _PLAIN.fullmatch(t) else None for t in texts]
        needed = set().union(*(w for w in split if w))
        missing = needed.difference(self.known)
        if len(self.known) + len(missing) > KEPT_WORDS:  # what these texts need stays, and short words while there is room
            kept = {w: ids for w, ids in self.known.items() if len(w) <= SHORT or w in needed}
            self.known = kept if len(kept) < KEPT_WORDS // 2 else {w: ids for w, ids in kept.items() if w in needed}
        if missing:
            self._learn(list(missing))
        known = self.known
        return [b"".join([known[w] for w in words]) if words is not None else self._raw(text).tobytes() for words, text in zip(split, texts)]


def groups(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch cut to slices of about ``limit`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long, ids binary"


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words, end = WordIds.at(path), np.array([end_id], "<u4").tobytes()
    part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
    for batch in batches:
        rows: list[list] = [[] for _ in range(8)]
        for some in groups(batch):
            for doc, blob in zip(some["doc_id"].to_pylist(), words.encode([t or "" for t in some["text"].to_pylist()])):
                blob += end
                total = len(blob) // 4
                for start in range(0, total, capacity):
                    cut = blob[4 * start : 4 * (start + capacity)]
                    n = len(cut) // 4
                    for column, value in zip(rows, (doc, start, n, zlib.crc32(cut), total, part, int(ranks[n]), cut if with_ids else None)):
                        column.append(value)
                    ranks[n] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows[:7]] + [pa.array(rows[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])


class Capacities:
    """Segment tree over remaining capacities: which is the least one, not below a length, that some open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)

    def put(self, capacity: int, there: bool) -> None:
        at = self.leaves + capacity
        self.some[at] = there
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = self.leaves + length
        if self.some[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths: rows (length, first rank, number, first sequence, offset).

    Pieces of one length are alike, so they are placed together: a sequence that is the tightest for one of them stays the
    tightest until no more fits, hence takes ``room // length`` of them. Work depends on the capacity, not on the data.
    """
    tree, plan, sequences = Capacities(capacity), [], 0
    open_: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, number: int) -> None:
        if number and room:
            open_.setdefault(room, []).append((first, number))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, number = capacity, -(-left // (capacity // length))
                first = sequences
                sequences += number
            else:
                first, number = open_[room].pop()
                if not open_[room]:
                    tree.put(room, False)
            each = room // length
            used = min(number, -(-left // each))
            placed = min(left, used * each)
            short = used * each - placed  # what the last sequence lacks
            for layer in range(each):
                here = used - (layer >= each - short)
                if here:
                    plan.append((length, rank, here, first, capacity - room + layer * length))
                    rank += here
            left -= placed
            add(room - each * length, first, used - (short > 0))
            if short:
                add(room - (each - short) * length, first + used - 1, 1)
            add(room, first + used, number - used)
    return plan, sequences


def _place(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    table = plan.value
    keys = table[:, 0] * 2**44 + table[:, 1]
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        at = np.searchsorted(keys, length * 2**44 + rank, side="right") - 1
        sequence = table[at, 3] + rank - table[at, 1]
        columns = [batch[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(table[at, 4], pa.int64()), batch["ids"]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless asked for).

    A document is its ids and then ``end_id``; documents over ``capacity`` are first cut into full windows and a rest.
    Pieces then go, longest first, into the open sequence with the least room that holds them. Only the histogram of
    lengths (at most ``capacity`` numbers) reaches the driver, where a segment tree over remaining capacities finds that
    room; ranks within a length, made of per-task counts and their running sums, tell each piece its place.

    Null and empty texts are one piece of one id. Repeated rows are packed each by itself; a null id stays null. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage(rows.mapInArrow(tidy(lambda it: _cut(it, tokenizer, capacity, end_id, with_ids)), PIECE), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select(F.struct("length", "part").alias("place"), (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"), "n")
    bases = stage(bases, "bases")
    sums = {r[0]: r[1] for r in bases.groupBy(F.col("place.length")).agg(F.sum("n")).collect()}
    plan, _ = best_fit(sums, capacity)
    table = docs.sparkSession.sparkContext.broadcast(np.array(sorted(plan), dtype="i8").reshape(-1, 5))
    ranked = lookup(pieces.withColumn("place", F.struct("length", "part")), bases.drop("n"), "place")
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"), "ids")
    return ranked.mapInArrow(lambda it: _place(it, table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
