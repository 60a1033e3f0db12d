"""Repair of damaged conversations by a dynamic programme over Re-Pair grammar symbols, shared by all conversations.

Turns become symbols of role and fault. Frequent pairs of symbols become rules of a grammar; every rule has one min-plus
matrix of costs between role states, with the edits as ropes. A sequence is the product of a few matrices then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, stage, tidy

#: Role states: nothing yet, after system, after user, after assistant; a repaired conversation ends in the first or last.
STATES, FINAL = 4, (0, 3)
#: From which states a role may follow, and the state that it leads to.
FOLLOWS = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
CLASSES, FAULTS = "sua?", ("", "truncated", "duplicate", "blank")
#: Rules of the grammar are characters from here on; symbols are 16 letters from ``A``.
RULE = 0xE000


class Rope:
    """A string put together of two others, so that matrices share what they have in common."""

    __slots__ = ("left", "right", "text", "size")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if left is None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                out.append(at.text)
            else:
                todo += (at.right, at.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.left is not None and (y.left is None or x.size >= y.size):
                a += (x.right, x.left)
                b.append(y)
            elif y.left is not None:
                b += (y.right, y.left)
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                if y.size > n:
                    b.append(Rope(y.text[n:]))
        return not a and bool(b)


#: A matrix is a mapping from (state before, state after) to (cost, rope of edits); what is not in it is impossible.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def least(a: Matrix, b: Matrix) -> Matrix:
    """Of each entry the cheaper, then the one with the smaller edits."""
    out = dict(a)
    for place, value in b.items():
        if place not in out or value < out[place]:
            out[place] = value
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``. Edits of equal cost for the same turns are never prefixes of each other (only insertions take
    no turn, and each costs), so the smallest edits of the parts give the smallest of the whole."""
    out: Matrix = {}
    for (i, k), (cost, edits) in a.items():
        for j in range(STATES):
            if (k, j) in b:
                more, rest = b[k, j]
                old = out.get((i, j))
                if old is None or cost + more < old[0]:
                    out[i, j] = (cost + more, edits + rest)
                elif cost + more == old[0] and (joined := edits + rest) < old[1]:
                    out[i, j] = (old[0], joined)
    return out


def _insertions() -> Matrix:
    one = {(i, to): (INSERT, Rope("I")) for role in "ua" for froms, to in [FOLLOWS[role]] for i in froms}
    none = {(i, i): (0, Rope()) for i in range(STATES)}
    once = least(none, one)
    return least(once, times(once, one))  # three insertions in a row lead where one does


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Any insertions, then what may become of one turn."""
    kind, fault = divmod(ord(symbol) - 65, 4)
    out = {(i, i): (DELETE, Rope("D")) for i in range(STATES)}
    if FAULTS[fault] in ("", "truncated"):
        extra = TRUNCATED * (fault == 1)
        for role, (froms, to) in FOLLOWS.items():
            if role == CLASSES[kind]:
                out = least(out, {(i, to): (extra, Rope("K")) for i in froms})
            elif role != "s":
                out = least(out, {(i, to): (REROLE + extra, Rope("R")) for i in froms})
    return times(INSERTIONS, out)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of every symbol and, bottom-up, of every rule (``rules[r]`` is a pair of earlier symbols)."""
    out = {chr(65 + k): symbol_matrix(chr(65 + k)) for k in range(16)}
    for r, (left, right) in enumerate(rules):
        out[chr(RULE + r)] = times(out[left], out[right])
    return out


def evaluate(sequence: str, known: dict[str, Matrix]) -> Matrix:
    """The product along a sequence of symbols and rules, as a balanced tree."""
    row = [known[c] for c in sequence]
    while len(row) > 1:
        row = [times(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0]


def grammar(sequences: DataFrame, rounds: int = 6, pairs: int = 24) -> tuple[list[str], DataFrame]:
    """Re-Pair over (symbols, weight): the rules, and the sequences with the column ``packed``, written in them.

    Each round counts neighbouring pairs over all sequences and makes rules of the ``pairs`` most frequent, which replace
    their pair from left to right. Only these few pairs reach the driver, so the grammar has at most rounds x pairs rules,
    whatever the data; what is left unpaired costs time, not results.
    """
    rules: list[str] = []
    now = stage(sequences.withColumn("packed", F.col("symbols")), "sequences")
    for _ in range(rounds):
        two = F.transform(F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring(F.col("packed"), i, 2))
        found = now.where(F.length("packed") > 1).select(F.explode(two).alias("pair"), "weight")
        best = [r[0] for r in found.groupBy("pair").agg(F.sum("weight").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(pairs).collect()]
        if not best:
            break
        packed = F.col("packed")
        for pair in best:
            packed = F.replace(packed, F.lit(pair), F.lit(chr(RULE + len(rules))))
            rules.append(pair)
        now = stage(now.withColumn("packed", packed), "sequences")
    return rules, now


def damage(turns: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes its ``[.!?]`` out, 3
    repeats it, 4 makes it a user's. Null roles and texts, and null ids and turns in the checksum's input, count as a space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1])), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _symbol(repeated: Column) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank, whole = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    fault = F.when(blank, 3).when(repeated, 2).when(~whole, 1).otherwise(0)
    return F.char(F.lit(65) + kind * 4 + fault)


FRAGMENT = "conv_id long, fragment long, symbols string, roles array<string>, texts array<string>"


def _fragments(batches: Iterator[pa.RecordBatch], turns: int, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns, up to ``turns`` of one conversation or ``size`` characters in a row; numbers follow the order of partitions."""
    number, held, chars = TaskContext.get().partitionId() << 33, [], 0

    def made():
        nonlocal number
        number += 1
        return (held[0][0], number, "".join(h[1] for h in held), [h[2] for h in held], [h[3] for h in held])

    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "symbol", "role", "text"))):
            if held and (row[0] != held[0][0] or len(held) >= turns or chars + len(row[3]) > size):
                out.append(made())
                held, chars = [], 0
            held.append(row)
            chars += len(row[3])
        if out:
            yield _batch(out, FRAGMENT)
    if held:
        yield _batch([made()], FRAGMENT)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


ENTRIES = "symbols string, froms array<int>, tos array<int>, costs array<int>, edits array<string>"


def _entries(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The matrix of every distinct fragment."""
    known = shared.value
    for batch in batches:
        rows = []
        for symbols, packed in zip(batch["symbols"].to_pylist(), batch["packed"].to_pylist()):
            cells = evaluate(packed, known)
            rows.append((symbols, [i for i, _ in cells], [j for _, j in cells], [c for c, _ in cells.values()], [str(e) for _, e in cells.values()]))
        if rows:
            yield _batch(rows, ENTRIES)


PIECE = "conv_id long, fragment long, piece string, before long, odd boolean, blank long, duplicate long, truncated long, illegal long, cost long"


def _compose(held: list[tuple]) -> list[tuple]:
    """The fragments of one conversation in order: its cheapest edits, cut where the fragments are cut."""
    state: dict[int, tuple[int, Rope]] = {0: (0, Rope())}
    back: list[dict[int, tuple[int, str]]] = []
    for _, _, _, froms, tos, costs, edits in held:
        step: Matrix = {(i, j): (c, Rope(e)) for i, j, c, e in zip(froms, tos, costs, edits)}
        new: dict[int, tuple[int, Rope]] = {}
        way: dict[int, tuple[int, str]] = {}
        for (i, j), (cost, rest) in step.items():
            if i in state:
                value = (state[i][0] + cost, state[i][1] + rest)
                if j not in new or value < new[j]:
                    new[j], way[j] = value, (i, rest.text)
        state = new
        back.append(way)
    ends = [((cost + more, edits + rest), i, rest.text) for i, (cost, edits) in state.items() for j in FINAL if (i, j) in INSERTIONS for more, rest in [INSERTIONS[i, j]]]
    (cost, _), at, tail = min(ends, key=lambda e: e[0])
    pieces = []
    for way in reversed(back):
        at, edits = way[at]
        pieces.append(edits)
    pieces.reverse()
    pieces[-1] += tail
    kinds = [divmod(ord(c) - 65, 4) for row in held for c in row[2]]
    faults = [sum(f == k for _, f in kinds) for k in (3, 2, 1)]
    illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for (a, _), (b, _) in zip(kinds, kinds[1:]))
    sizes = [len(p) - p.count("D") for p in pieces]
    out, before, odd = [], 0, sum(sizes) % 2 == 1
    for row, piece, n in zip(held, pieces, sizes):
        out.append((row[0], row[1], piece, before, odd, *faults, illegal, cost))
        before += n
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "fragment", "symbols", "froms", "tos", "costs", "edits"))):
            if held and row[0] != held[0][0]:
                out += _compose(held)
                held = []
            held.append(row)
        if out:
            yield _batch(out, PIECE)
    if held:
        yield _batch(_compose(held), PIECE)


REPAIRED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired_turns(piece: str, roles: list[str], texts: list[str], before: int, odd: bool) -> list[tuple[str, str]]:
    """The turns that edits make of a fragment. After ``before`` turns the role follows from the place: users and assistants
    take turns, after a system turn where the number of all turns is odd."""
    out, row = [], 0
    for edit in piece:
        place = before + len(out) - odd
        role = "user" if place % 2 == 0 else "assistant"
        if edit == "I":
            out.append((role, ""))
            continue
        if edit != "D":
            out.append((roles[row] if edit == "K" else role, texts[row]))
        row += 1
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with their edits, in order: one row a conversation; its text is hashed as it comes and never held."""
    last, facts, audit, digest, begun = None, None, [], None, False
    done = lambda: (*facts, "".join(audit), digest.hexdigest())
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if digest is None or row["conv_id"] != last:
                if digest is not None:
                    out.append(done())
                last, audit, digest, begun = row["conv_id"], [], hashlib.sha256(), False
                facts = tuple(row[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost"))
            audit.append(row["piece"])
            for role, text in repaired_turns(row["piece"], row["roles"], row["texts"], row["before"], row["odd"]):
                digest.update(f"{chr(10) * begun}{role}:{text}".encode("utf-8", "surrogatepass"))
                begun = True
        if out:
            yield _batch(out, REPAIRED)
    if digest is not None:
        yield _batch([done()], REPAIRED)


def repair_plan(turns: DataFrame, fragment_turns: int = 64, fragment_chars: int = 200_000, rounds: int = 6, pairs: int = 24) -> tuple[DataFrame, DataFrame]:
    """Fragments of all conversations with their turns, and the cheapest edits by fragment.

    Turns are sorted over the whole cluster by conversation, turn (nulls first), role and text and cut into fragments of at
    most ``fragment_turns``, so a long conversation is many rows in many tasks. Distinct fragments are written in one grammar
    and each is evaluated once, however many conversations hold it.
    """
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role"), "role", "text"), 256))
    rows = stage(turns.select("conv_id", "turn", "role", "text", key.alias("key"), F.monotonically_increasing_id().alias("row")), "turns")
    again = rows.groupBy("key").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    marked = lookup(rows, again, "key")
    repeated = F.col("first").isNotNull() & ~F.struct("turn", "row").eqNullSafe(F.col("first"))
    marked = stage(marked.select("conv_id", "turn", "role", "text", "row", _symbol(repeated).alias("symbol")), "marked")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    fragments = stage(ranged.select("conv_id", "symbol", "role", "text").mapInArrow(tidy(lambda it: _fragments(it, fragment_turns, fragment_chars)), FRAGMENT), "fragments")
    rules, sequences = grammar(fragments.groupBy("symbols").agg(F.count(F.lit(1)).alias("weight")), rounds, pairs)
    shared = turns.sparkSession.sparkContext.broadcast(matrices(rules))
    entries = stage(sequences.select("symbols", "packed").mapInArrow(lambda it: _entries(it, shared), ENTRIES), "matrices")
    placed = lookup(fragments.select("conv_id", "fragment", "symbols"), entries, "symbols", 50_000)
    pieces = placed.repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(tidy(_pieces), PIECE)
    return fragments, stage(pieces, "pieces")


def repair_conversations(turns: DataFrame, **options) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns (conv_id, turn, role, text; no nulls in role and text) are read by turn, nulls first; equal turns by role and text.
    A turn's first fault counts: blank, a repeat of role and text, or not ended by ``[.!?]``. The cheapest edits keep (0),
    give a turn another role (3), delete it (4; blank and repeated turns must go) or insert an empty one (3); truncated turns
    that stay cost 3. ``audit`` is the edits' initials in order, the least in ASCII of the cheapest; the repaired roles
    are nothing, or an optional system turn and then user and assistant by turns. Roles go by their initials; a null
    conversation is one of its own. Extra columns are ignored; no rows give no rows. The audit and the hash of a conversation
    are one value each, so their last step reads that conversation's fragments one by one in a single task.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    fragments, pieces = repair_plan(turns, **options)
    done = fragments.join(pieces.drop("conv_id"), "fragment").repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(tidy(_hashed), REPAIRED)
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    gaps = gaps.withColumnRenamed("conv_id", "conv")
    return gaps.join(done, F.col("conv").eqNullSafe(F.col("conv_id"))).select("conv_id", "gaps", *[c.split(" ")[0] for c in REPAIRED.split(", ")][1:])


def op11_conversation_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    repaired = repair_conversations(damage(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(repaired, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
