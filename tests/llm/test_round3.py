"""Conversation repair, substring dedup and token alignment against slow versions, on awkward rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import conversation_repair as repair
from clauseloom.llm import substring_dedup as dedup
from clauseloom.llm import token_alignment as align

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["row", "key", "symbol", "rank", "proof", "starts", "ends", "packet", "slice", "segment", "groups", "fragment", "piece", "n"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


# --- conversation repair

sys.setrecursionlimit(20_000)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    return out


def mended(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, r, x in rows:
        letters = WORD.findall(x)
        faults.append("blank" if not letters else "dup" if (r, x) in seen else "trunc" if letters[-1][-1] not in ".!?" else "")
        seen.add((r, x))

    @lru_cache(None)
    def best(i, state, added):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def also(cost, edit, role, after):
            if after is not None:
                found.append((cost + after[0], edit + after[1], ((edit, role),) + after[2]))

        for role in "ua":
            if added < 3 and (state, role) in NEXT:
                also(3, "I", role, best(i, NEXT[state, role], added + 1))
        if i < len(rows):
            also(4, "D", "", best(i + 1, state, 0))
            if faults[i] in ("", "trunc"):
                more, own = 3 * (faults[i] == "trunc"), rows[i][2][:1]
                if (state, own) in NEXT:
                    also(more, "K", "", best(i + 1, NEXT[state, own], 0))
                for role in "ua":
                    if (state, role) in NEXT:
                        also(3 + more, "R", role, best(i + 1, NEXT[state, role], 0))
        return min(found) if found else None

    cost, audit, moves = best(0, 0, 0)
    lines, i = [], 0
    for edit, role in moves:
        lines += [f"{FULL[role]}:"] if edit == "I" else [f"{rows[i][2]}:{rows[i][3]}"] if edit == "K" else [f"{FULL[role]}:{rows[i][3]}"] if edit == "R" else []
        i += edit != "I"
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("dup"), faults.count("trunc"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def talks():
    rng, rows = random.Random(8), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "cut. ", "same.", "same.", "wörd。", "a\x0b.\x0c"]
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            if rng.random() < 0.9:
                rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += [(500, t, "user" if t % 2 else "assistant", f"turn {t % 7}" + "." * (t % 3)) for t in range(150)]  # many fragments
    rows += [(None, t, "user", "x.") for t in range(5)] + [(501, None, None, None), (502, 3, "user", "q"), (502, 3, "user", "q"), (502, 3, "assistant", "z.")]
    return rows


@pytest.mark.parametrize("options", [{}, {"fragment_turns": 3, "rounds": 2, "pairs": 3}, {"rounds": 0}])
def test_repair_equals_enumeration(spark, options):
    rows = talks()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(7)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(repair.damage(df), **options).collect()}
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    assert got == {c: mended(rs) for c, rs in by.items()}


def test_repair_query_gives_every_conversation(spark, tmp_path):
    lost = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (1, 1, "user", "a."), (1, 2, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = repair.op11_conversation_repair(spark, str(tmp_path))
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got[lost] == NOTHING and got[1] == mended(damaged(rows[1:]))
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert repair.op11_conversation_repair(spark, str(tmp_path / "none")).count() == 0


def test_matrices_compose_in_any_grouping():
    rng = random.Random(3)
    for _ in range(200):
        symbols = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randint(1, 9)))
        rules = [symbols[:2]] if len(symbols) > 1 else []
        plain = repair.evaluate(symbols, repair.matrices([]))
        packed = repair.evaluate(symbols.replace(rules[0], chr(repair.RULE)) if rules else symbols, repair.matrices(rules))
        show = lambda m: {k: (c, str(e)) for k, (c, e) in m.items()}
        left = repair.symbol_matrix(symbols[0])
        for s in symbols[1:]:
            left = repair.times(left, repair.symbol_matrix(s))
        assert show(plain) == show(packed) == show(left)


# --- substring dedup


def without_repeats(rows, window):
    last, first, out = 2**63 - 1, {}, []
    words = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for rank, _, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(rank, first.get(key, last))
    for rank, i, w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [50, 6, 2])
def test_substring_dedup_equals_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    vocabulary = ["".join(rng.choice("abcdeéß你") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other, near = prose(window + 30), prose(window), prose(4 * window).split()
    rows = [(i, f"{prose(rng.randint(0, 2 * window))} {rng.choice([passage, other, passage[5:], ''])}\n{prose(rng.randint(0, window))}") for i in range(60)]
    for k in range(8):
        near[rng.randrange(len(near))] = f"edit{k}"
        rows.append((200 + k, " ".join(near)))
    rows += [(300, None), (301, ""), (302, " \x0b\n"), (None, passage), (None, passage), (7, "again " + passage), rows[3], rows[3], (400, "la " * 500), (401, "la " * 300), (402, prose(6000)), (-5, other), (403, " nbsp\u0085x\x1cy " * window)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    expected = without_repeats(rows, window)
    assert Counter(map(tuple, dedup.substring_dedup(df, window).collect())) == expected
    # long texts in parts, more slices, nothing broadcast
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, dedup.substring_dedup(df, window, slice_runs=10).collect())) == expected
    assert dedup.substring_dedup(df.limit(0), window).count() == 0


def test_parts_and_spans_of_long_texts(spark):
    data = ("word " * 1000 + "x" * 5000 + " end").encode()
    assert [w for part in dedup.parts(data, 700) for w in part] == data.split()


def test_count_min_never_underestimates():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2000, 5000).astype("u4")
    distinct, n = np.unique(keys, return_counts=True)
    assert (dedup.count_min(distinct, n.astype("f8")) >= n).all()
    single = rng.choice(2**32, 3000, replace=False).astype("u4")
    assert (dedup.count_min(single, np.ones(3000)) < 2).mean() > 0.7


# --- token alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled(texts):
    """Each text's A and B tokens as (id, first byte, end), or None; by the tokenizers alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printed)}
    for text in texts:
        if not text:
            yield None
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            yield None
            continue
        yield tuple([(i, e - len(x), e) for i, x, e in zip(ids, parts, np.cumsum([len(x) for x in parts]).tolist())] for ids, parts in ((ia, ba), (ib, bb)))


def aligned(texts):
    rows, counts = [], Counter()
    for tokens in spelled(texts):
        if tokens is None:
            rows.append(None)
            continue
        a, b = tokens
        groups, common = [], sorted({x[2] for x in a} & {x[2] for x in b})
        for low, high in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


ODD = [None, "", " ", "  a", "a b ", "x▁y", "tab\there", "nl\n\nnl  two", "你好 世界" * 40, "<|endoftext|> <s> <0x41>", "it's we'll don't 123 4,5", "a b c  d \x1f e", "\x00 null", "é̀ ﬁ ½", "word " * 200, "x" * 700, " " * 90, "emoji 👩‍👩‍👧 ok", "same words here", "same words here"]


@pytest.mark.parametrize("options", [{}, {"segment": 12, "broadcast_bytes": -1, "slices": 3}])
def test_alignment_equals_tokenizers_alone(spark, options):
    rng = random.Random(2)
    syllables = ["tion", "ing", "the", "an", "er", "’s", "。", "é", "12", ",", "…"]
    texts = ODD + ["".join(rng.choice(syllables) + rng.choice(["", "", " ", "\n", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    df = clashing(spark.createDataFrame([*enumerate(texts), (None, "no id"), (None, None)], "doc_id long, text string")).repartition(3)
    out = align.align_tokens(df, A, B, **options)
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out.collect())
    expected = aligned([*texts, "no id", None])
    assert got == Counter((i, *row) for i, row in zip([*range(len(texts)), None, None], expected))
    assert align.align_tokens(df.limit(0), A, B, **options).count() == 0


def test_fragments_of_any_cut_compose_to_the_same_groups():
    rng = random.Random(4)
    for a, b in filter(None, spelled(t for t in ODD if t and len(t) < 300)):
        size, ids = a[-1][2], lambda side: ([i for i, _, _ in side], [e for _, _, e in side])
        whole = align.finish(align.fragment(*ids(a), *ids(b)))
        for _ in range(5):
            cuts = sorted({0, size, *(rng.randint(0, size) for _ in range(rng.randint(0, 8)))})
            made = [align.fragment(*(x for side in (a, b) for x in ids([t for t in side if low < t[2] <= high])), number=k) for k, (low, high) in enumerate(zip(cuts, cuts[1:]))]
            while len(made) > 1:  # any grouping
                k = rng.randrange(len(made) - 1)
                made[k : k + 2] = [align.compose(made[k], made[k + 1])]
            assert [g for _, g in align.finish(made[0])] == [g for _, g in whole]
            assert align.compose(align.EMPTY, made[0]) == made[0] == align.compose(made[0], align.EMPTY)


def test_fast_and_slow_encoders_agree():
    tokens = align.Tokens.at(A, B)
    for text in filter(None, ODD):
        assert tokens.fast(" " + text) == tokens.slow.encode(" " + text, add_special_tokens=False).ids
