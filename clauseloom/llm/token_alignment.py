"""Alignment of two tokenizers' tokens by byte ranges: an associative monoid of fragments, composed by a tree over Spark tasks."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage, tidy
from .ngram_join import _STEP, _mix

#: Bits of a B id in a pair's number, bytes of text in a packet, bytes above which a text is cut into segments, segments that
#: one step of the tree composes, units that a worker keeps, and bytes of a unit above which the slower encoder takes over.
B_BITS, PACKET, SEGMENT, FAN, KEPT_UNITS, LONG_UNIT = 15, 2_000_000, 65_536, 8, 100_000, 10_000
#: Packets, and segments with their fragments, that a row group and a batch for Python hold: some ten megabytes, whatever a task reads.
PACKETS_HELD, SEGMENTS_HELD = 4, 100
#: Bytes of the table of pair counts up to which every executor gets all of it; beyond that, each packet asks for its own pairs.
BROADCAST_BYTES = 32_000_000


class Entry(NamedTuple):
    """Closed groups: how many tokens and groups, the groups as text, and the links' pair numbers."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: bytes


NOTHING = Entry(0, 0, 0, "", b"")


class Tokens:
    """Both tokenizers, the bytes of their tokens, and the alignment of units of text, which a worker keeps."""

    _made: dict[tuple[str, str], Tokens] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        model, special = told["model"], {t["content"] for t in told["added_tokens"]}
        # byte-level: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ids = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items() if token not in special}
        self.a_bytes = [ids.get(i, b"") for i in range(max(model["vocab"].values()) + 1)]
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks={token: i for i, token in ids.items()}, special_tokens={}).encode_ordinary
        self.a_path = a_path
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        named = [(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in range(len(self.pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in named]
        self.a_size, self.b_size = (np.array([len(x) for x in y], "i8") for y in (self.a_bytes, self.b_bytes))
        self.known: dict[str, Entry | None] = {}
        #: An id with what may follow it: in its list, before the B ids, before the next group, before the next stretch.
        self.shown = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in (",", "|", ";", "\n")]

    @classmethod
    def at(cls, a_path: str, b_path: str) -> Tokens:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
            give_back()  # what reading the vocabularies took
        return cls._made[a_path, b_path]

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        return made

    def encode(self, unit: str) -> tuple[list[int], list[int]]:
        a = self.fast(" " + unit) if len(unit) < LONG_UNIT else self.slow.encode(" " + unit, add_special_tokens=False).ids
        return a, self.pieces.encode(unit)

    def spelled(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw

    def learn(self, units: list[str], step: int = 2000) -> None:
        """Units go to the encoders many at a time, joined by the spaces at which texts are cut; where that is not spelled out
        as it stands, and for units that begin or end in white space, one by one."""
        single = [u for u in units if not u or u[0].isspace() or u[-1].isspace() or len(u) >= LONG_UNIT]
        apart = set(single)
        plain = [u for u in units if u not in apart]
        for at in range(0, len(plain), step):
            some = plain[at : at + step]
            joined = " ".join(some)
            raw = (" " + joined).encode()
            a, b = self.fast(" " + joined), self.pieces.encode(joined)
            if self.spelled(a, b, raw):
                a, b = np.array(a), np.array(b)
                ends = np.cumsum([len(u.encode()) + 1 for u in some])
                na, nb = (np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0) for ids, size in ((a, self.a_size), (b, self.b_size)))
                self.known.update(zip(some, self.align(a, b, na, nb)))
            else:
                single += some
        for u in single:
            a, b = self.encode(u)
            fine = self.spelled(a, b, (" " + u).encode())
            self.known[u] = next(iter(self.aligned([a], [b]))) if fine else None

    def aligned(self, a: list[list[int]], b: list[list[int]]) -> list[Entry]:
        """Of each stretch that both tokenizers cover from end to end, its groups and links."""
        flat = [np.fromiter((i for x in y for i in x), "i8") for y in (a, b)]
        return self.align(*flat, *(np.array([len(x) for x in y], "i8") for y in (a, b)))

    def align(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[Entry]:
        """The same for stretches one after the other, which have ``na`` and ``nb`` tokens."""
        if not len(na):
            return []
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_from, b_from = a_end - self.a_size[a], b_end - self.b_size[b]
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        low, high = np.searchsorted(b_end, a_from, side="right"), np.searchsorted(b_from, a_end, side="left")
        n = high - low
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        pairs = ((np.repeat(a, n) << B_BITS) | b[other]).astype("<u4").tobytes()
        # the groups as one text: A and B ids by group, each followed by what stands after it
        side = np.r_[np.zeros(len(a), "i8"), np.ones(len(b), "i8")]
        group = np.r_[np.searchsorted(common, a_end), np.searchsorted(common, b_end)]
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, ids = group[order], side[order], np.r_[a, b][order]
        last = np.r_[(group[1:] != group[:-1]) | (side[1:] != side[:-1]), True]
        mark = np.where(last, 1 + side, 0)
        ends = np.searchsorted(common, a_end[np.cumsum(na) - 1])  # the last group of each stretch
        final = np.zeros(len(common), bool)
        final[ends] = True
        mark[last & (side == 1) & final[group]] = 3
        texts = "".join(map(self.shown.__getitem__, (ids * 4 + mark).tolist())).split("\n")
        links = (np.cumsum(n)[np.cumsum(na) - 1] * 4).tolist()
        return [Entry(x, y, g, t, pairs[i:j]) for x, y, g, t, i, j in zip(na.tolist(), nb.tolist(), np.diff(ends, prepend=-1).tolist(), texts, [0, *links], links)]

    def all(self, units: set[str]) -> dict[str, Entry | None]:
        missing = [u for u in units if u not in self.known]
        for at in range(0, len(missing), 20_000):
            self.learn(missing[at : at + 20_000])
        return self.known

    def forget(self) -> None:
        """Beyond ``KEPT_UNITS``, as many of the short units stay as half of that holds; they are the frequent ones."""
        if len(self.known) <= KEPT_UNITS:
            return
        sizes, kept, longest = Counter(map(len, self.known)), 0, -1
        for length in sorted(sizes):
            kept += sizes[length]
            if kept > KEPT_UNITS // 2:
                break
            longest = length
        self.known = {u: e for u, e in self.known.items() if len(u) <= longest}


#: A space beside white space or at an end.
_AWKWARD = re.compile(r" \s|\s |\A | \Z")


def units(text: str) -> list[str]:
    """A text cut at single spaces between other characters that are no white space: neither tokenizer has a token across
    such a place, so units are encoded each by itself."""
    split = text.split(" ")
    if _AWKWARD.search(text):
        out = split[:1]
        for u in split[1:]:
            if u and out[-1] and not u[0].isspace() and not out[-1][-1].isspace():
                out.append(u)
            else:
                out[-1] += " " + u
        return out
    return split


# --- the monoid

class Fragment(NamedTuple):
    """Tokens that end in one range of bytes. ``head``: (A ids, B ids) up to the first byte where tokens of both end, open to
    the left; ``closed``: the groups after it, or None if there is no such byte; ``tail``: what is after the last one, open to
    the right. ``closed`` is a list of (range number, group), so that text stays where it is while ends are composed."""

    head: tuple[list[int], list[int]]
    closed: list[tuple[int, tuple[list[int], list[int]]]] | None
    tail: tuple[list[int], list[int]]


EMPTY = Fragment(([], []), None, ([], []))


def _join(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment, number: int = 0) -> Fragment:
    """``x`` and then ``y``: what is open between them becomes a group, under the number of the range in which it ends."""
    if x.closed is None:
        return Fragment(_join(x.head, y.head), y.closed, y.tail)
    if y.closed is None:
        return Fragment(x.head, x.closed, _join(x.tail, y.head))
    return Fragment(x.head, x.closed + [(number, _join(x.tail, y.head))] + y.closed, y.tail)


def fragment(a: list[int], a_end: list[int], b: list[int], b_end: list[int], number: int = 0) -> Fragment:
    """The fragment of tokens with their ends, all in one range."""
    common = sorted(set(a_end) & set(b_end))
    cuts = [(sum(e <= c for e in a_end), sum(e <= c for e in b_end)) for c in common]
    if not cuts:
        return Fragment((a, b), None, ([], []))
    groups = [(number, (a[i:k], b[j:m])) for (i, j), (k, m) in zip(cuts, cuts[1:])]
    (i, j), (k, m) = cuts[0], cuts[-1]
    return Fragment((a[:i], b[:j]), groups, (a[k:], b[m:]))


def finish(x: Fragment) -> list[tuple[int, tuple[list[int], list[int]]]]:
    """All groups of a whole text, whose beginning and end are ends of both tokenizers."""
    return [(0, x.head)] * (x.closed is not None) + (x.closed or [])


# --- packets: what some texts hold, in a few arrays

PACKED = "packet long, ids binary, absent binary, keys binary, n_a binary, n_b binary, n_groups binary, n_links binary, sizes binary, uses binary, lasts binary, links binary, pairs binary, shas array<string>"
_FIELDS = (("ids", "i8"), ("absent", "u1"), ("keys", "i8"), ("n_a", "i8"), ("n_b", "i8"), ("n_groups", "i8"), ("n_links", "i8"), ("sizes", "i4"), ("uses", "u4"), ("lasts", "i8"), ("links", "u4"), ("pairs", "u4"))


def _packet(number: int, rows: list[tuple], entries: list[Entry], uses: list[np.ndarray], shas: list[str | None]) -> pa.RecordBatch:
    """``rows``: (doc_id, key) of each text, ``uses``: the numbers of its entries."""
    sizes = np.array([len(u) for u in uses], "i8")
    use = np.concatenate(uses) if uses else np.zeros(0, "i8")
    at = np.r_[0, np.cumsum(sizes)]
    facts = [np.r_[0, np.cumsum(np.array([e[k] for e in entries], "i8")[use])] if len(use) else np.zeros(1, "i8") for k in range(3)]
    each = np.array([len(e.links) // 4 for e in entries], "i8")
    facts.append(np.r_[0, np.cumsum(each[use])] if len(use) else np.zeros(1, "i8"))
    sums = [f[at[1:]] - f[at[:-1]] for f in facts]
    pairs, links = np.unique(np.frombuffer(b"".join([e.links for e in entries]), "<u4"), return_inverse=True)
    columns = [np.array([i or 0 for i, _ in rows]), np.array([i is None for i, _ in rows]), np.array([k for _, k in rows]), *sums, sizes, use, np.cumsum(each), links, pairs]
    return pa.RecordBatch.from_arrays([pa.array([number])] + [pa.array([np.asarray(c).astype(kind).tobytes()], pa.binary()) for c, (_, kind) in zip(columns, _FIELDS)] + [pa.array([shas], pa.list_(pa.string()))], names=["packet"] + [n for n, _ in _FIELDS] + ["shas"])


def _gathered(batches: Iterator[pa.RecordBatch], limit: int = PACKET) -> Iterator[list]:
    """Rows (doc_id, text) of several batches together, about ``limit`` bytes at a time."""
    rows, size = [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            rows.append((doc, text))
            size += len(text)
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _short(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Whole texts: one packet for some megabytes."""
    tokens, number = Tokens.at(a_path, b_path), TaskContext.get().partitionId() << 33
    for rows in _gathered(batches):
        split = [units(t) if t else [] for _, t in rows]
        index = {u: k for k, u in enumerate(dict.fromkeys(u for x in split for u in x))}
        known = tokens.all(index.keys())
        entries = [known[u] for u in index]
        bad = {k for k, e in enumerate(entries) if e is None}
        entries = [e or NOTHING for e in entries]
        texts, uses, shas = [e.text for e in entries], [], []
        for x in split:
            use = [index[u] for u in x]
            if bad and not bad.isdisjoint(use):
                use = []
            uses.append(np.array(use, "i8"))
            shas.append(hashlib.sha256(";".join([texts[k] for k in use]).encode()).hexdigest() if use else "")
        packet = _packet(number, [(d, -1) for d, _ in rows], entries, uses, shas)
        del split, index, entries, texts, uses, shas
        tokens.forget()
        give_back()
        yield packet
        number += 1


SEGMENTS = "key long, doc_id long, segment long, text string"


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Long texts in segments of at least ``size`` characters, cut where both tokenizers end; a text without such a place stays whole."""
    key = TaskContext.get().partitionId() << 33
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            at, rows = 0, []
            while at < len(text):
                end = text.find(" ", at + size)
                while 0 < end < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
                    end = text.find(" ", end + 1)
                end = end if 0 < end < len(text) - 1 else len(text)
                rows.append((key, doc, len(rows), text[at:end]))
                at = end + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["key", "doc_id", "segment", "text"])
            key += 1


_OPEN = "head_a array<int>, head_b array<int>, closed boolean, tail_a array<int>, tail_b array<int>, between array<struct<segment:long,a:array<int>,b:array<int>>>"
FRAGMENTS = f"key long, doc_id long, segment long, fine boolean, {_OPEN}, groups string, packed binary"
_GROUPS = pa.list_(pa.struct([("segment", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def _columns(x: Fragment) -> tuple:
    return (*x.head, x.closed is not None, *x.tail, [{"segment": n, "a": a, "b": b} for n, (a, b) in x.closed or []])


def _opened(row: dict) -> Fragment:
    closed = [(g["segment"], (g["a"], g["b"])) for g in row["between"]] if row["closed"] else None
    return Fragment((row["head_a"], row["head_b"]), closed, (row["tail_a"], row["tail_b"]))


def _fragments(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """A segment's fragment: its first group is open to the left, the others go to a packet of their own."""
    tokens = Tokens.at(a_path, b_path)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), _GROUPS, pa.string(), pa.binary())
    for batch in batches:
        for key, doc, segment, text in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "segment", "text"))):
            split = units(text)
            known = tokens.all(set(split))
            row = [known[u] for u in split]
            tokens.forget()
            fine = None not in row
            x, groups, packed = EMPTY, "", None
            if fine:
                a, b = tokens.encode(split[0])
                whole = fragment(a, np.cumsum(tokens.a_size[a]).tolist(), b, np.cumsum(tokens.b_size[b]).tolist(), segment)
                row[:1] = tokens.aligned([g for _, (g, _) in whole.closed], [g for _, (_, g) in whole.closed])
                x = whole._replace(closed=[])
                groups = ";".join([e.text for e in row])
                index = {id(e): k for k, e in enumerate({id(e): e for e in row}.values())}
                entries = list({id(e): e for e in row}.values())
                made = _packet(0, [(doc, key)], entries, [np.array([index[id(e)] for e in row], "i8")], [None])
                packed = _blob(made)
            values = (key, doc, segment, fine, *_columns(x), groups, packed)
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=[c.split(" ")[0] for c in ("key", "doc_id", "segment", "fine", "head_a", "head_b", "closed", "tail_a", "tail_b", "between", "groups", "packed")])


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unblob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId() << 33, 1 << 60
    for batch in batches:
        for blob in batch["packed"].to_pylist():
            for made in pa.ipc.open_stream(blob):
                yield made.set_column(0, "packet", pa.array([number + part]))
                number += 1


TREE = f"key long, doc_id long, segment long, {_OPEN}"


def _composed(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """One level of the tree: sorted fragments of a text, ``fan`` neighbours to one."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), _GROUPS)
    names = ["key", "doc_id", "segment", "head_a", "head_b", "closed", "tail_a", "tail_b", "between"]
    now, value, doc = None, EMPTY, None

    def out():
        values = (now[0], doc, now[1], *_columns(value))
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["key"], row["segment"] // fan)
            if at != now:
                if now is not None:
                    yield out()
                now, value, doc = at, _opened(row), row["doc_id"]
            else:
                value = compose(value, _opened(row), row["first"])
    if now is not None:
        yield out()


def _finished(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Composed texts: the groups that the tree closed, as text by segment, and a packet of them."""
    tokens = Tokens.at(a_path, b_path)
    for batch in batches:
        for row in batch.to_pylist():
            groups = finish(_opened(row))
            entries = tokens.aligned([a for _, (a, _) in groups], [b for _, (_, b) in groups])
            packed = _blob(_packet(0, [(row["doc_id"], row["key"])], entries, [np.arange(len(entries))], [None]))
            n = len(groups)
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n), pa.array([k for k, _ in groups], pa.int64()), pa.array([e.text for e in entries], pa.string()), pa.array([packed] + [None] * (n - 1), pa.binary())], names=["key", "segment", "groups", "packed"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group texts in order: each text's digest, taken as they come."""
    now, digest, begun, out = None, None, False, []
    for batch in batches:
        for key, groups in zip(batch["key"].to_pylist(), batch["groups"].to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, begun = key, hashlib.sha256(), False
            if groups:
                digest.update((";" * begun + groups).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["key", "sha"])
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "sha"])


# --- counting pairs over the corpus

ASKED = "slice int, salt int, packet long, pairs binary, counts binary"


def _slice_of(pairs: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a pair, by its B id, so that all pairs of a B id meet."""
    b = (pairs & np.uint32((1 << B_BITS) - 1)).astype("u8")
    return (_mix(b + np.uint64(_STEP)) % np.uint64(slices)).astype("i4")


def _asked(batches: Iterator[pa.RecordBatch], slices: int, salts: int) -> Iterator[pa.RecordBatch]:
    """How many links of a packet hold each of its pairs, by slice."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, uses, lasts, links, pairs = (np.frombuffer(row[n], dict(_FIELDS)[n]) for n in ("sizes", "uses", "lasts", "links", "pairs"))
            if not len(pairs):
                continue
            used = np.bincount(uses, minlength=len(lasts))
            counts = np.bincount(links, weights=np.repeat(used, np.diff(np.r_[0, lasts])), minlength=len(pairs)).astype("i8")  # of one packet, so that 32 bits do
            where = _slice_of(pairs, slices)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(slices + 1))
            rows = [(k, row["packet"] % salts, row["packet"], pairs[order[x:y]].tobytes(), counts[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            yield _rows(rows, ASKED)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _summed(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted by ``by``: the sum of the counts of each pair; a few megabytes of pairs are held at a time."""
    now, held, size = None, [], 0

    def fold():
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return [(pairs, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype("i8"))]

    def out():
        (pairs, counts), = fold()
        return _rows([(now[0], 0, 0, pairs.tobytes(), counts.tobytes())], ASKED)

    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[k] for k in by)
            if at != now:
                if now is not None:
                    yield out()
                now, held, size = at, [], 0
            held.append((np.frombuffer(row["pairs"], "u4"), np.frombuffer(row["counts"], "i8")))
            size += len(held[-1][0])
            if size > 1_000_000 + 2 * len(held[0][0]):
                held = fold()
                size = len(held[0][0])
    if now is not None:
        yield out()


def _best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id's; all pairs of the B ids are there."""
    b = pairs & np.uint32((1 << B_BITS) - 1)
    order = np.lexsort((counts, b))
    if not len(order):
        return np.zeros(0, bool)
    last = np.r_[b[order][1:] != b[order][:-1], True]
    most = np.zeros(1 << B_BITS, "i8")
    most[b[order][last]] = counts[order][last]
    return counts == most[b]


ANSWER = "packet long, pairs binary, counts binary, best binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by slice and salt, the slice's table first: the counts that each packet asks for."""
    table = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            pairs = np.frombuffer(row["pairs"], "u4")
            if row["packet"] == -1:
                counts = np.frombuffer(row["counts"], "i8")
                table = (pairs, counts, _best(pairs, counts))
                continue
            at = np.searchsorted(table[0], pairs)
            out.append((row["packet"], row["pairs"], table[1][at].tobytes(), table[2][at].tobytes()))
        if out:
            yield _rows(out, ANSWER)


RESULT = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _totals(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Every text's sums over its links, from the table of all pairs or from the packet's own answers."""
    kinds = [pa.int64()] * 8 + [pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            x = {n: np.frombuffer(row[n], kind) for n, kind in _FIELDS}
            if shared is not None:
                pairs, counts, best = shared.value
            else:
                parts = row["answers"] or []
                pairs, counts, best = (np.concatenate([np.frombuffer(p[n], kind) for p in parts] or [np.zeros(0, kind)]) for n, kind in (("pairs", "u4"), ("counts", "i8"), ("best", "?")))
                order = np.argsort(pairs)
                pairs, counts, best = pairs[order], counts[order], best[order]
            at = np.searchsorted(pairs, x["pairs"])[x["links"]]
            sums = []
            for value in (best, counts):
                link = np.r_[0, np.cumsum(value[at].astype("i8"))]
                unit = link[x["lasts"]] - link[np.r_[0, x["lasts"][:-1]]] if len(x["lasts"]) else np.zeros(0, "i8")
                use = np.r_[0, np.cumsum(unit[x["uses"]])]
                end = np.cumsum(x["sizes"].astype("i8"))
                sums.append(use[end] - use[end - x["sizes"]])
            columns = [x["keys"], np.ma.array(x["ids"], mask=x["absent"].astype(bool)), x["n_a"], x["n_b"], x["n_groups"], x["n_links"], *sums, row["shas"]]
            yield pa.RecordBatch.from_arrays([pa.array(c.filled(0), kind, mask=np.ma.getmaskarray(c)) if isinstance(c, np.ma.MaskedArray) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[c.split(" ")[0] for c in RESULT.split(", ")])


@contextmanager
def rows_in_batches(spark, rows: int):
    """While it lasts, tables go to Python in batches of at most ``rows``, so that a batch of texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, slices: int = 128, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text's tokens of both tokenizers are cut into groups wherever both have an end; a link is a pair of tokens that share
    bytes. Texts up to ``segment`` bytes are done where they are read. Longer ones are cut into segments in rows of their
    own; each gives a fragment (open head, closed groups, open tail), and rounds of composing ``FAN`` neighbours lead to one
    fragment a text, whose closed groups stay in their segments. Pair counts are summed by slices of the B ids, and every text
    looks up its own: in the whole table while that is small, else each packet of texts asks the slices for its pairs.

    Null and empty texts, and texts that the tokens of either do not spell out, have zeros and an empty hash and count
    nowhere. Repeated rows count each by itself; a null id stays null. A text that offers no cut is tokenized in one task.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.octet_length("text") > segment
    spark = docs.sparkSession
    with rows_in_batches(spark, 1000):
        packets = stage(rows.where(~long).mapInArrow(tidy(lambda it: _short(it, a_path, b_path)), PACKED), "packets", PACKETS_HELD)
    hashes = None
    with rows_in_batches(spark, SEGMENTS_HELD):
        segments = stage(rows.where(long).mapInArrow(lambda it: _cut(it, segment), SEGMENTS), "segments", SEGMENTS_HELD)
    if segments.take(1):
        with rows_in_batches(spark, SEGMENTS_HELD):
            parts = stage(segments.repartition("key", "segment").mapInArrow(tidy(lambda it: _fragments(it, a_path, b_path)), FRAGMENTS), "fragments", SEGMENTS_HELD)
        known = parts.groupBy("key").agg(F.min("fine").alias("fine"), F.max("segment").alias("last"), F.max("doc_id").alias("doc_id"))
        known = stage(known, "long-texts")
        good = known.where("fine").select("key")
        parts = parts.join(good, "key", "left_semi")
        tree = parts.select("key", "doc_id", "segment", "head_a", "head_b", "closed", "tail_a", "tail_b", "between", F.col("segment").alias("first"))
        left, span = known.agg(F.max("last")).first()[0] + 1, FAN
        while True:
            level = tree.repartition("key", F.floor(F.col("segment") / FAN)).sortWithinPartitions("key", "segment").mapInArrow(lambda it: _composed(it, FAN), TREE)
            left = -(-left // FAN)
            if left <= 1:
                break
            tree, span = stage(level.withColumn("first", F.col("segment") * span), "tree"), span * FAN
        with rows_in_batches(spark, SEGMENTS_HELD):
            closed = stage(level.mapInArrow(lambda it: _finished(it, a_path, b_path), "key long, segment long, groups string, packed binary"), "closed")
        texts = closed.select("key", "segment", F.lit(0).alias("place"), "groups").unionByName(parts.select("key", "segment", F.lit(1).alias("place"), "groups"))
        inside = parts.select("packed").unionByName(closed.where("packed is not null").select("packed"))
        with rows_in_batches(spark, SEGMENTS_HELD):
            hashes = stage(texts.repartition("key").sortWithinPartitions("key", "segment", "place").mapInArrow(_hashed, "key long, sha string"), "hashes")
            packets = packets.unionByName(stage(inside.mapInArrow(_unblob, PACKED), "long-packets", SEGMENTS_HELD))
    number = packets.count()
    salts = max(1, number // 20_000)
    with rows_in_batches(spark, PACKETS_HELD):
        asked = stage(packets.select("packet", "sizes", "uses", "lasts", "links", "pairs").mapInArrow(tidy(lambda it: _asked(it, slices, salts)), ASKED), "asked")
    table = asked.repartition("slice", "salt").sortWithinPartitions("slice", "salt").mapInArrow(lambda it: _summed(it, ("slice", "salt")), ASKED)
    if salts > 1:
        table = table.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda it: _summed(it, ("slice",)), ASKED)
    table = stage(table, "pair-counts")
    size = table.agg(F.sum(F.octet_length("pairs") + F.octet_length("counts"))).first()[0] or 0
    if size <= broadcast_bytes:
        found = table.select("pairs", "counts").collect()  # at most broadcast_bytes
        pairs, counts = (np.concatenate([np.frombuffer(bytes(r[k]), kind) for r in found] or [np.zeros(0, kind)]) for k, kind in enumerate(("u4", "i8")))
        order = np.argsort(pairs)
        shared = spark.sparkContext.broadcast((pairs[order], counts[order], _best(pairs[order], counts[order])))
        answered = packets
    else:
        shared, salted = None, table.select("slice", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("packet"), "pairs", "counts")
        replies = salted.unionByName(asked).repartition("slice", "salt").sortWithinPartitions("slice", "salt", "packet").mapInArrow(_answers, ANSWER)
        replies = replies.groupBy("packet").agg(F.collect_list(F.struct("pairs", "counts", "best")).alias("answers"))
        answered = packets.join(replies, "packet", "left")
    with rows_in_batches(spark, PACKETS_HELD):
        result = stage(answered.mapInArrow(tidy(lambda it: _totals(it, shared)), RESULT), "totals")
    if hashes is None:
        return result.drop("key")
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    whole = known.select("key", "doc_id").join(result.where("key >= 0").groupBy("key").agg(*sums), "key", "left").join(hashes, "key", "left")
    whole = whole.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("sha", F.lit("")).alias("groups_sha256"))
    return result.where("key < 0").drop("key").unionByName(whole)


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
