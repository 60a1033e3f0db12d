"""Every operator on small tables with nulls, empty, long and repeated rows and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import chat_format, embedding_dedup, exact_dedup, lm_score, mixing, ngram_join, packing, quality, suffix_dedup, toxicity
from clauseloom.llm import common

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOW = {65 + i: 97 + i for i in range(26)}
#: Columns that clash with names the operators use inside.
CLASH = ["digest", "slot", "node", "n", "row", "part", "key", "shard", "size", "taken", "spans", "score", "label", "a", "b", "comp"]


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(200), prose(90)
    out = [None, "", " \n\t ", "one", "ONE", "two words", "A b c d e", "a B c d e", "a b c d e f", base, base, base.upper(), None, ""]
    near = base.split()
    for k in range(6):
        near = list(near)
        near[rng.randrange(len(near))] = f"changed{k}"
        out.append(" ".join(near))
    out += [prose(60) + " " + passage + " " + prose(50), prose(30) + " " + passage, passage + " " + passage, "x" * 1500, "The " * 400, prose(9000), "line one\n" * 40, "it's 3½ — 你好 <|endoftext|> İ ſ", " nbsp\u0085next\x1cfile"]
    out += [prose(rng.randint(1, 120)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "no id", "s1"), (1000, rows[20][1], "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def groups(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# --- shared helpers


def test_components_and_lookup_without_broadcasts(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    expected = groups(800, [e for e in edges if e[0] != e[1]])
    for limit in (500_000, 3):
        got = {r["node"]: r["comp"] for r in common.components(df, limit).collect()}
        assert got == {x: expected[x] for e in edges if e[0] != e[1] for x in e}
    assert common.components(df.limit(0)).count() == 0
    big = spark.range(40_000).select((F.col("id") % 3 * F.when(F.col("id") % 7 == 0, 0).otherwise(1)).alias("k"), "id")
    table = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    for limit in (10, 1):
        got = Counter((r["k"], r["v"]) for r in common.lookup(big, table, "k", limit).collect())
        assert set(got) == {(0, "x"), (1, "y"), (2, None)} and sum(got.values()) == 40_000


# --- 8


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, rows, empty, keep):
    by = defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    pick = max if keep == "largest" else min
    expected = Counter()
    for i, t, _ in rows:
        own = by[t or ""]
        best = pick((x for x in own if x is not None), default=None)
        expected[(i, best, len(own), i == best, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, keep=keep, ways=2).collect())
    assert got == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- 7


def test_jaccard_components(docs, rows, empty):
    def shingles(t):
        w = WORDS.findall((t or "").translate(LOW))
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets = [shingles(rows[k][1]) for k in order]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(len(sets), links)
    expected = Counter((rows[order[k]][0], len(sets[k]), rows[order[root[k]]][0]) for k in range(len(sets)))
    for options in ({}, {"few": 1, "block_sets": 3, "broadcast_rows": 0, "fragment_rows": 50}):
        got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs, **options).select("doc_id", "n_shingles", "component_id").collect())
        assert got == expected
    assert ngram_join.jaccard_components(empty).count() == 0


def test_jaccard_components_of_groups_that_are_no_clique(spark):
    """Copies that drift apart, copies without an id, and two sets of equal size that share most shingles but too few."""
    rng = random.Random(12)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    data, line = [], prose(8)
    for base in (prose(100), prose(160), prose(60)):
        at = list(base)
        for k in range(60):
            if rng.random() < 0.3:
                at = list(base)
            at[rng.randrange(len(at))] = f"x{k}"
            data.append(" ".join(at + line * (k % 2)))
    rows = [(None if i % 17 == 0 else i, t) for i, t in enumerate(data)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, data)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = groups(len(sets), links)
    least = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, root):
        least[r] = min(least[r], 10**9 if i is None else i)
    expected = Counter((i, least[r] if least[r] < 10**9 else i) for (i, _), r in zip(rows, root))
    assert 3 < len(set(root)) < 170
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"few": 3, "block_sets": 5}, {"few": 1, "block_sets": 64, "fragment_rows": 20}):
        got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df, **options).collect())
        assert got == expected


def test_word_hashes_tell_structured_words_apart():
    thue = b"a"
    for _ in range(10):
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    other = thue.translate(bytes.maketrans(b"ab", b"ba"))
    one, two, again = (next(ngram_join.shingle_sets(pa.array([t.decode()]))) for t in (thue, other, thue.upper()))
    assert one.tolist() != two.tolist() and one.tolist() == again.tolist()


# --- 6


@pytest.mark.parametrize("length", [100, 400])
def test_repeated_spans(docs, rows, empty, length):
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    expected = Counter()
    for i, b in raw:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\x01" * length
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(cover)))
        expected[(i, spans)] += 1
    got = Counter((r["doc_id"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in suffix_dedup.repeated_spans(docs, length, bits=14).collect())
    assert got == expected
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_spans_of_very_long_texts_cut_into_parts(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(900)
    texts_ = [noise(3000) + passage + noise(2500), passage + noise(700) + passage[:500], noise(2000)]
    raw = [t.encode() for t in texts_]
    cut = [list(suffix_dedup.parts(pa.array([t]), 100)) for t in texts_]
    assert [len(c) for c in cut] == [1, 1, 1]
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    monkeypatch.setattr(suffix_dedup, "slices", lambda a, limit=1: ngram_join.slices(a, 1))
    for t, b in zip(texts_, raw):
        starts = [shift + k for _, data, offsets, shift in suffix_dedup.parts(pa.array([t]), 100) for k in range(len(data) - 99)]
        assert starts == list(range(len(b) - 99))
        for _, data, offsets, shift in suffix_dedup.parts(pa.array([t]), 100):
            gram, at, first, last, _, _ = suffix_dedup.anchors(data, offsets, 100)
            assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
            assert (at >= last).all() and (at + suffix_dedup.GRAM <= first + 100).all()  # the anchor lies in every window


def test_pieces_of_one_hash_are_compared_by_their_bytes():
    data = np.frombuffer(b"abcdXabcdYabcdXabce", "u1")
    first, size = np.array([0, 10, 5, 14]), np.array([5, 5, 5, 5])
    assert suffix_dedup._alike(data, first, size, np.array([0, 1, 2, 3]), np.array([1, 2, 3])).tolist() == [True, False, False]
    assert suffix_dedup._alike(data, first, size, np.array([0, 1, 2, 3]), np.array([1, 2, 3]), step=5).tolist() == [True, False, False]


def test_suffix_query_equals_brute_force(spark, tmp_path, docs, rows):
    """The five columns of the query, over a table of its own."""
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[s : s + 400] for _, b in raw for s in range(len(b) - 399))
    expected = Counter()
    for i, b in raw:
        cover = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                cover[s : s + 400] = b"\x01" * 400
        kept = bytes(x for x, c in zip(b, cover) if not c)
        expected[(i, len(b), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r) for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == expected and sum(k[2] > 0 for k in got) > 3


# --- 5


def test_pack(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 512):
            expected[(i, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()), len(ids))] += 1
    out = packing.pack(docs, path, capacity=512, with_ids=True).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert len(sequences) <= math.ceil(sum(r["length"] for r in out) / 512) + 1
    assert packing.pack(empty, path).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        rooms = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= n]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(capacity - n)
        plan, sequences = packing.best_fit(counts, capacity)
        assert sequences == len(rooms)
        used = defaultdict(list)
        for length, rank, many, first, offset in plan:
            for k in range(many):
                used[first + k].append((offset, length))
        left = []
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            left.append(capacity - at)
        assert sorted(left) == sorted(rooms)
        for n, c in counts.items():
            ranks = sorted(r + k for length, r, many, _, _ in plan if length == n for k in range(many))
            assert ranks == list(range(c))


# --- 4


def test_mixing(docs, rows, empty):
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size)
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= 3 * own[s]
        free -= over
    target |= {s: weight[s] * share for s in free}
    one = mixing.taken(docs, block_words=16, shard_words=900).collect()
    two = mixing.taken(docs.repartition(3), block_words=16, shard_words=900).collect()
    assert len(one) == len(rows)
    taken = defaultdict(int)
    for r in one:
        assert r["source_size"] == own[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in names)
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    assert mixing.taken(empty).count() == 0


def test_mix_pieces_are_disjoint_and_shards_even(docs):
    _, pieces = mixing.mix_sources(docs, block_words=16, shard_words=900)
    found = pieces.collect()
    seen, shards = set(), Counter()
    for p in found:
        words = {(p["row"], p["epoch"], p["start"] + k) for k in range(p["words"])}
        assert not words & seen
        seen |= words
        shards[p["shard"]] += p["words"]
    assert max(shards.values()) - min(shards.values()) <= 16 * 8


def test_mix_tree_of_many_shards(docs):
    """Beyond eight levels the nodes are spread; what is taken stays, and shards still hold equal numbers of disjoint blocks."""
    deep = dict(block_words=4, shard_words=12)
    assert Counter(map(tuple, mixing.taken(docs, **deep).collect())) == Counter(map(tuple, mixing.taken(docs).collect()))
    found = mixing.mix_sources(docs, **deep)[1].collect()
    seen, shards = set(), Counter()
    for p in found:
        words = {(p["row"], p["epoch"], p["start"] + k) for k in range(p["words"])}
        assert not words & seen
        seen |= words
        shards[p["shard"]] += p["words"]
    assert max(shards) >= 2**mixing.SPREAD and max(shards.values()) <= 4 * (math.ceil(sum(shards.values()) / 4 / (max(shards) + 1)) + 2)


def test_mix_of_one_source_with_repeats_and_no_words(spark):
    data = [(1, "a b c", None), (1, "a b c", None), (None, "d", None), (2, None, None), (3, " ", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken(df).collect()]
    assert Counter(got) == Counter([(1, 3, 7, 7.0, 3)] * 2 + [(None, 1, 7, 7.0, 1), (2, 0, 7, 7.0, 0), (3, 0, 7, 7.0, 0)])


def test_block_order_is_a_permutation_for_any_number_of_blocks(spark):
    for every in (1, 2, 7, 1000, 65537):
        df = spark.range(every).select(F.col("id").alias("rank"), F.lit(every).cast("long").alias("all"), F.lit(3).alias("number"))
        assert {r[0] for r in df.select(mixing._permuted("rank", "all", 17)).collect()} == set(range(every))
    many = [2**45 + 11, 2**46 - 1, 3 * mixing.STEP]
    data = [(n - k, n, 3) for n in many for k in (1, 2, 99999)] + [(0, n, 3) for n in many]
    df = spark.createDataFrame(data, "rank long, all long, number int")
    got = {(r["rank"], r["all"]): r["b"] for r in df.select("rank", "all", mixing._permuted("rank", "all", 17).alias("b")).collect()}
    for (rank, every), b in got.items():
        step = mixing.OTHER if every % mixing.STEP == 0 else mixing.STEP
        assert b == (rank * step + got[0, every]) % every


def test_hypergeometric_draws(spark):
    x = "named_struct('total', 30L, 'own', 12L, 'take', 11L)"
    df = spark.range(8000).select(F.expr(x).alias("x"), F.rand(3).alias("u"), F.lit(0).alias("z")).select(F.expr(mixing._DRAW).alias("d"))
    counts = Counter(r["d"] for r in df.collect())
    for k in range(12):
        p = math.comb(12, k) * math.comb(18, 11 - k) / math.comb(30, 11)
        assert abs(counts[k] / 8000 - p) < 4 * math.sqrt(p / 8000) + 1e-3


# --- 2


def test_chat_round_trip(spark):
    part = lambda type, text=None, ref=None, w=None, h=None, s=None, p=None: (type, text, ref, w, h, s, p)
    nasty = "\\### Assistant: </turn> ok\n### user: <image x> \\\\ \\"
    data = [
        (1, 0, "user", [part("text", nasty), part("image", ref="a<b>.png", w=100, h=50), part("audio", ref="s.wav", s=2.5)]),
        (1, 1, "assistant", [part("text", nasty)]),
        (1, 2, "assistant", None),
        (1, 40, "us:er #1", [part("document", ref="d.pdf", p=3), part("text", None)]),
        (2, None, None, [part("text", "")]),
        (None, 0, "assistant", [part("text", "x")]),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>").withColumn("chunk", F.lit(1)).withColumn("body", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.parse_chats(chat_format.format_chats(df, F.col("parts"))).collect()}
    one = got[1]
    assert [t["role"] for t in one["turns"]] == ["user", "assistant", "assistant", "us:er #1"]
    assert one["turns"][1]["text"] == nasty and one["loss_text"] == nasty
    assert [(a["segment"], a["part"], a["type"], a["ref"], a["n_tokens"]) for a in one["attachments"]] == [(0, 1, "image", "a<b>.png", 8), (0, 2, "audio", "s.wav", 32), (3, 0, "document", "d.pdf", 768)]
    assert one["attachment_tokens"] == 808
    assert one["formatted"].count(" </turn>\n") == 4
    assert got[2]["turns"][0]["role"] == "" and got[2]["loss_text"] == "" and got[None]["loss_text"] == "x"
    assert chat_format.format_chats(df.limit(0), F.col("parts")).count() == 0


def test_chat_parts_are_read_back(spark):
    rng = random.Random(9)
    odd = ["<", ">", " ", "\\", "\\b", "#", ":", "b", "image", " </turn>\n", "###", "\n", "é"]
    word = lambda n: "".join(rng.choice(odd) for _ in range(rng.randint(0, n)))
    data, wanted = [], {}
    for conv in range(60):
        for turn in range(3):
            parts = [("text", word(8), None) if rng.random() < 0.5 else (word(3) or "image", None, word(6)) for _ in range(rng.randint(0, 5))]
            data.append((conv, turn, word(3), [(t, x, r, None, None, None, None) for t, x, r in parts]))
            joined = []
            for t, x, r in parts:
                if t != "text":
                    joined.append((t, None, r))
                elif x and joined and joined[-1][0] == "text":
                    joined[-1] = ("text", joined[-1][1] + x, None)
                elif x:
                    joined.append((t, x, None))
            wanted[conv, turn] = joined
    data.append((-1, 0, None, [("text", "x <" * 200_000, None, None, None, None, None), ("image", None, None, None, None, None, None)]))
    wanted[-1, 0] = [("text", "x <" * 200_000, None), ("image", None, "")]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    for r in chat_format.read_parts(chat_format.format_chats(df, F.col("parts"))).collect():
        for turn, parts in enumerate(r["parts"]):
            assert [tuple(p) for p in parts] == wanted[r["conv_id"], turn]
        assert len(r["parts"]) == sum(k == r["conv_id"] for k, _ in wanted)


# --- 9


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    data = [(k, [float(x) for x in rng.standard_normal(16)]) for k in range(120)]
    for k in range(120, 200):
        base = np.array(data[k % 7][1])
        data.append((k, [float(x) for x in base + rng.standard_normal(16) * 0.08 * np.abs(base).mean() * 3]))
    data += [(300, data[3][1]), (301, data[3][1]), (302, [2 * x for x in data[3][1]]), (303, None), (304, []), (305, [0.0] * 16), (306, [float("nan")] * 16), (307, [None] + [1.0] * 15), (308, [float("inf")] * 16), (309, [1.0, 2.0]), (310, [1.0, 2.0]), (311, [1e300] * 16), (312, [1e300] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).withColumn("key", F.lit("clash"))
    ids, unit = [i for i, _ in data], []
    for _, v in data:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / max(map(abs, v)) if ok else None)
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root, count = groups(len(ids), links), Counter(x for e in links for x in e)
    for options in ({}, {"cell_rows": 1000, "block_rows": 16, "guest_rows": 50}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df, **options).collect()}
        assert got == {i: (count[k], ids[root[k]], root[k] == k) for k, i in enumerate(ids)}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["low", "axis", "spread"])
def test_no_link_is_lost_between_cells(spark, kind):
    """Vectors in a subspace, near copies that differ along one axis that also parts the cells, and even ones: several cells."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 6 if kind == "low" else 24))
    move = rng.standard_normal(base.shape) * 0.2
    if kind == "axis":
        base[:, 0] *= 6
        move = np.zeros_like(base)
        move[:, 0] = 0.3 * np.sqrt((base * base).sum(1)) * rng.choice([-1, 1], len(base))
    both = np.concatenate([base, base + move])
    unit = both / np.sqrt((both * both).sum(1, keepdims=True))
    if kind == "low":
        unit = np.c_[unit, np.zeros((len(unit), 18))]
    cosine = unit @ unit.T
    links = (cosine >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    for reach in (embedding_dedup.REACH, None):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df, cell_rows=150, reach=reach).collect()}
        found = sum(got.values())
        assert (links.sum() == found if reach is None else found >= 0.999 * links.sum()) and links.sum() > 1000


# --- 10 and 3


def labelled(spark, n=400):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    data = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(rng.randint(1, 9))]
        good, rude = i % 4 != 0, i % 5 == 0
        if not good:
            lines = [x.upper().replace(" ", "!! ") if rng.random() < 0.8 else x for x in lines]
        if rude:
            lines[0] += " you " + rng.choice(["idiot", "scum", "rudeword" + rng.choice("xyz")])
        data.append((i, "\n".join(lines), int(good), int(rude)))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text", F.lit("clash").alias("label"), F.lit("clash").alias("score")), df.select("doc_id", "quality", "toxic")


def test_quality(spark, docs, empty):
    table, labels = labelled(spark)
    model = quality.train_quality(table, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(table, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= quality.THRESHOLD) == truth[i] for i in held]) > 0.93
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(empty, model).count() == 0
    bare = quality.train_quality(table, labels.limit(0))
    assert quality.score_quality(table, bare).where("score > 0.3").count() == 400
    wild = labels.select("doc_id", F.lit(None).cast("int").alias("quality")).unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("quality")))
    assert quality.train_quality(table, wild)["b"] == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2])
    odds, move = rng.standard_normal(7), rng.standard_normal((2, 2))
    good, moved = quality.marginals(counts, odds, move)
    at, expected, pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        total, own, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = math.exp(sum(odds[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            own += w * np.array(y)
            for k in range(n - 1):
                both[y[k], y[k + 1]] += w
        expected += list(own / total)
        pairs += both / total
        at += n
    assert np.allclose(good, expected) and np.allclose(moved, pairs)


def test_toxicity(spark, docs, empty):
    table, labels = labelled(spark)
    model = toxicity.train_toxicity(table, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_toxicity(table, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.4) == truth[i] for i in held]) > 0.95
    assert toxicity.score_toxicity(docs, model).count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.score_toxicity(table, toxicity.train_toxicity(table, labels.limit(0))).count() == 400


# --- 1


def test_lm_score(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = [[*(t or "").encode().lower().split(), b""] for _, t, _ in rows]
    count = Counter(w for r, ws in zip(rows, words) if not held(r[0]) for w in ws)
    total, kinds = sum(count.values()), len(count)
    got = defaultdict(list)
    for r in lm_score.lm_score(docs, path, training={"steps": 60}).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (i, _, _), ws in zip(rows, words):
        r = got[i][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), total, held(i))
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_score.lm_score(empty, path).count() == 0


def test_id_pairs_are_counted_exactly_over_distinct_training_words(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    encode = lm_score.encoder(path).encode_ordinary
    ids = lambda w: [*lm_score.word_ids(w, encode).tolist(), lm_score.END]
    learnt = {w for i, t, _ in rows if not held(i) for w in lm_score.split(t)}
    pairs = Counter(p for w in learnt for p in zip(ids(w), ids(w)[1:]))
    first = Counter(p for w in learnt for p in ids(w)[:-1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)).alias("learn"))
    chunks = common.stage(texts.mapInArrow(lambda it: lm_score._chunks(it, 3000), "chunk long, docs binary"), "chunks")
    asked, (_, _, _, befores, afters) = lm_score.counted(chunks, path, 6)
    assert chunks.count() > 2 and befores.tolist() == [first[k] for k in range(lm_score.IDS)] and afters.sum() == befores.sum()
    answers = defaultdict(dict)
    for r in asked.where("fragment >= 64").collect():
        answers[r["chunk"]][r["fragment"]] = r["counts"]
    for r in chunks.collect():
        words = lm_score.vocabulary(lm_score._read(r["docs"]))[0]
        here = {p for w in words for p in zip(ids(w), ids(w)[1:])}
        key = lambda p: int(lm_score.pair_key(np.array(p[:1]), np.array(p[1:]))[0])
        assert len(set(map(key, here))) == len(here)
        got = b"".join(n for _, n in sorted(answers[r["chunk"]].items()))
        assert np.frombuffer(got, "i8").tolist() == [pairs[p] for p in sorted(here, key=key)]
    m = {"pair_total": befores, "broad": (afters + 0.1) / (afters.sum() + 0.1 * lm_score.IDS)}
    every = np.arange(lm_score.IDS)
    for b in list(first)[:20]:
        counts = np.array([pairs[b, a] for a in range(lm_score.IDS)])
        assert math.isclose(lm_score.pair_odds(counts, np.full(lm_score.IDS, b), every, m).sum(), 1, rel_tol=1e-9)


def test_lm_score_does_not_depend_on_the_chunks(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    few, many = (sorted((r["doc_id"] or 0, r["score"]) for r in lm_score.lm_score(docs.repartition(parts), path, training={"steps": 60, "shard_windows": 40}, chunk_bytes=size).collect()) for size, parts in ((10_000_000, 3), (3000, 5)))
    assert [i for i, _ in few] == [i for i, _ in many] and np.allclose([x for _, x in few], [x for _, x in many], rtol=1e-5)


def test_many_words_have_the_ids_of_each():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode, begins = lm_score.encoder(path).encode_ordinary, lm_score.start_ids(path)
    words = sorted({w for t in texts() for w in lm_score.split(t)} | {"a\u00a0b".encode(), "\u3000x".encode(), "it's".encode(), "…".encode(), b"\x1c", b"<|endoftext|>", b"12,5%"})
    pool, size = lm_score.many_word_ids(words, encode, begins)
    assert [x.tolist() for x in np.split(pool, np.cumsum(size)[:-1])] == [lm_score.word_ids(w, encode).tolist() for w in words]
    assert lm_score.many_word_ids([], encode, begins)[0].size == 0


def test_model_gives_the_next_ids_a_distribution_in_every_window():
    rng = np.random.default_rng(5)
    model = lm_score.new_model() | {"O": rng.standard_normal((lm_score.WIDTH, lm_score.CLASSES)).astype("f4")}
    classes = rng.integers(0, lm_score.CLASSES, lm_score.IDS)
    many = np.bincount(classes, minlength=lm_score.CLASSES)
    model |= {"classes": classes, "row": rng.integers(0, lm_score.OWN, lm_score.IDS), "within": -np.log(many[classes])}
    head = rng.integers(0, lm_score.IDS, 41)
    every = [np.r_[head, k] for k in range(0, lm_score.IDS, 1)]
    total = sum(np.exp(lm_score.score_streams(lm_score.folded(model), every[k : k + 5000])[0].reshape(-1, 41)[:, -1]).sum() for k in range(0, len(every), 5000))
    assert math.isclose(total, 1, rel_tol=1e-3)
    for scale in (1, 20):  # with and without the maximum taken off
        big = lm_score.folded(model | {"O": model["O"] * scale})
        long = rng.integers(0, lm_score.IDS, 60)
        z = lm_score.forward(model | {"O": model["O"] * scale}, big["row"][long[None, 16:48]])[0][0]
        assert np.isclose(lm_score.score_streams(big, [long])[0][47], z[31, classes[long[48]]] + big["within"][long[48]], atol=1e-3)


def test_windows_score_every_token_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 200])
    doc, first, skip = lm_score.windows_of(lengths)
    seen = Counter()
    for d, f, s in zip(doc, first, skip):
        for place in range(s, lm_score.WINDOW):
            if f + place < lengths[d]:
                seen[(d, f + place)] += 1
    assert seen == Counter((d, k) for d, n in enumerate(lengths) for k in range(n))


def test_attention_is_causal():
    rng = np.random.default_rng(1)
    f = lambda *shape: rng.standard_normal(shape).astype("f4")
    W, C, T = lm_score.WIDTH, lm_score.CLASSES, lm_score.WINDOW
    model = {"E": f(50, W), "Q": f(W, W), "K": f(W, W), "V": f(W, W), "r": f(T), "O": f(W, C), "b": f(C)}
    rows = rng.integers(0, 50, (2, T))
    other = rows.copy()
    other[:, 20:] = (other[:, 20:] + 1) % 50
    a, b = lm_score.forward(model, rows)[0], lm_score.forward(model, other)[0]
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5) and np.allclose(np.exp(a).sum(2), 1, atol=1e-4)
