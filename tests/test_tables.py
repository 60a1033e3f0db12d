"""Versioned tables, incremental extraction and the chain of clause fallbacks."""

import re

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import rules as R
from clauseloom.operators import extract, graph
from clauseloom.sources import corpus as C
from clauseloom.sources.store import VersionedTables
from clauseloom.streaming import incremental as I

SHAPE = "doc_id long, part int, value string"


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture
def store(spark, tmp_path):
    made = VersionedTables(spark, str(tmp_path / "t"), {"notes": ["doc_id", "part"], "papers": ["doc_id", "part"]}, buckets=8)
    rows = [(i, k, f"{i}.{k}") for i in range(40) for k in range(2)]
    made.commit(1, {"notes": table(spark, rows), "papers": table(spark, rows)})
    return made


def rows_of(store, spark, name, version=None):
    return sorted(map(tuple, store.read(name, table(spark, []).schema, version).collect()))


def test_upserts_and_deletes_are_counted_and_old_versions_stay(spark, store):
    before = rows_of(store, spark, "notes")
    told = store.commit(2, {"notes": table(spark, [(3, 0, "new"), (99, 0, "added")])}, gone=spark.createDataFrame([(5,)], "doc_id long"))
    assert sorted(map(tuple, told.collect())) == [("notes", 2, 1, 2), ("papers", 0, 0, 2)]
    after = {(d, p): v for d, p, v in rows_of(store, spark, "notes")}
    assert after[3, 0] == "new" and after[3, 1] == "3.1" and after[99, 0] == "added" and (5, 0) not in after
    assert rows_of(store, spark, "notes", 1) == before and store.rows() == {"notes": 79, "papers": 78}
    whole = store.commit(3, {"notes": table(spark, [(3, 7, "only")])}, whole=True)
    assert sorted(map(tuple, whole.collect())) == [("notes", 1, 0, 2), ("papers", 0, 0, 2)]
    assert [r for r in rows_of(store, spark, "notes") if r[0] == 3] == [(3, 7, "only")]


def test_untouched_buckets_keep_their_files_and_look_ups_open_few(spark, store):
    schema = table(spark, []).schema
    files = set(store.read("notes", schema).inputFiles())
    store.commit(2, {"notes": table(spark, [(3, 0, "new")])})
    after = set(store.read("notes", schema).inputFiles())
    assert len(files - after) == 1 and len(after - files) == 1
    found = store.look_up("notes", schema, [3, 4])
    assert sorted(r["value"] for r in found.collect()) == ["3.1", "4.0", "4.1", "new"]
    assert len(found.inputFiles()) <= 2 < len(after)


def test_a_commit_that_fails_halfway_shows_nothing_and_runs_again(spark, store):
    before = rows_of(store, spark, "notes")
    broken = table(spark, [(1, 0, "x")]).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(2, {"notes": table(spark, [(1, 0, "half")]), "papers": broken})
    assert store.version() == 1 and rows_of(store, spark, "notes") == before
    store.commit(2, {"notes": table(spark, [(1, 0, "whole")]), "papers": table(spark, [(1, 0, "whole")])})
    assert store.version() == 2 and len(rows_of(store, spark, "notes")) == len(before)
    again = store.commit(2, {"notes": table(spark, [(1, 0, "ignored")])})  # done before
    assert again.count() == 2 and (1, 0, "whole") in rows_of(store, spark, "notes")
    assert store.clear(3).agg(F.sum("rows")).first()[0] == 160 and rows_of(store, spark, "notes") == []


def test_a_batch_that_fails_halfway_is_extracted_again(spark, tmp_path):
    docs = C.corpus(spark, "/root/testdata/sf0.001").where("doc_id < 40").select("doc_id", F.lit(0).alias("revision"), "styled", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    cells = C.cells(spark, "/root/testdata/sf0.001")
    store = I.extraction_store(spark, str(tmp_path / "t"), 4)
    real, calls = store.commit, []

    def once(version, rows, **options):
        calls.append(version)
        if len(calls) == 1:
            real(version, {**rows, "facts": rows["facts"].withColumn("value", F.raise_error(F.lit("lost")).cast("string"))}, **options)
        return real(version, rows, **options)

    store.commit = once
    with pytest.raises(Exception, match="lost"):
        I.extract_available(stream, cells, store, str(tmp_path / "offsets"))
    assert store.version() == 0
    first = I.extract_available(stream, cells, store, str(tmp_path / "offsets"))
    assert calls == [1, 1] and first["facts"].count() == graph.complete(docs, cells.join(docs, "doc_id", "left_semi"))["facts"].count() > 300
    assert first["clauses"].select("doc_id").distinct().count() == docs.count()


START = re.compile(extract.SECTION_START)


def chain(paragraphs, kind):
    """The fallback chain by hand, list by list; ``paragraphs``: (text, styled)."""

    def promoted(rows):
        out = []
        for text, styled in rows:
            t = text.strip()
            head = styled or bool(t) and (bool(re.match(r"^\d+(\.\d+)*\.?\s+[A-Z]", t)) and len(t) < 80 or bool(re.match(r"^[A-Z][A-Z\s\-&/]{3,59}$", t)) and len(t.split()) <= 8)
            out.append((text, head))
        return out

    heads = lambda rows: [t.strip() for t, h in rows if h and t.strip()]
    tells = lambda hs: any(kind[h] != "general" for h in hs)
    styled = heads(paragraphs)
    if tells(styled):
        return styled
    split = []
    for text, s in paragraphs:
        t = text.strip()
        if len(t) >= 80:
            split += [(f"{m.group(1)}. {m.group(2).strip()}", False) for m in START.finditer(t)]
        split.append((text, s))
    if len(split) > len(paragraphs) and tells(heads(promoted(split))):
        return heads(promoted(split))
    if tells(heads(promoted(paragraphs))):
        return heads(promoted(paragraphs))
    return styled or heads(promoted(paragraphs))


def test_clause_chain_equals_lists_side_by_side(spark):
    import random

    rng = random.Random(5)
    long = "some words that fill a block of text until it is long enough to be split by the rule "
    parts = ["1. ZEBRA MATTERS", "TERM AND TERMINATION", "ALL CAPITALS HERE", "2. Payment Terms", "body text.", "", long + "5. PERSONNEL  and more", long + "6. CONFIDENTIALITY 6.1 x 7. NOTICES  y", long, "3. " + "LONG " * 20 + "HEAD", long + "8. " + "VERY " * 20 + "LONG  z"]
    docs = [[(rng.choice(parts), rng.random() < 0.2) for _ in range(rng.randint(1, 5))] for _ in range(300)]
    rows = [(d, i, t, "Heading 1" if s else None) for d, ps in enumerate(docs) for i, (t, s) in enumerate(ps)]
    got: dict[int, list[str]] = {}
    outcomes = set()
    for r in extract.chained_clauses(spark.createDataFrame(rows, "doc_id long, idx int, text string, style string")).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append(r["heading"])
        outcomes.add(r["outcome"])
    names = {t.strip() for ps in docs for t, _ in ps} | {f"{m.group(1)}. {m.group(2).strip()}" for ps in docs for t, _ in ps for m in START.finditer(t.strip())}
    kind = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "h string").select("h", R.classify_heading(F.col("h"))).collect()}
    assert outcomes == {"styled", "split", "promoted", "rest"}
    for d, ps in enumerate(docs):
        assert got.get(d, []) == chain(ps, kind), ps


def test_live_counts_write_changed_keys_only_and_go_on_after_a_restart(spark, tmp_path):
    waves, seen = [["a", "a", "b", None], ["c"], ["a", "c", None]], {}
    for wave in waves:
        spark.createDataFrame([(v,) for v in wave], "v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in"))
        out = I.live_counts(stream, "v", folder=str(tmp_path / "live"))
        for v in wave:
            seen[v] = seen.get(v, 0) + 1
        assert {r["v"]: r["n"] for r in out.collect()} == seen
    rows = spark.read.parquet(str(tmp_path / "live" / "rows")).groupBy("at").agg(F.collect_list("v").alias("vs"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["at"]: (sorted(r["vs"]), r["n"]) for r in rows} == {0: (["a", "b"], 3), 1: (["c"], 1), 2: (["a", "c"], 3)}


def test_the_sweep_finds_the_nearest_fact(spark):
    import random

    rng, wanted, facts, best = random.Random(1), [], [], {}
    for d in range(120):
        own = [(o, a := rng.randint(0, 40), a + rng.randint(1, 15)) for o in rng.sample(range(50), rng.randint(0, 9))]
        facts += [(d, f"f{o}", o, a, b) for o, a, b in own]
        for k in range(rng.randint(0, 5)):
            s = rng.randint(0, 50)
            e = s + rng.randint(0, 8)
            wanted.append((d, f"k{k}", s, e))
            over = [o for o, a, b in own if a <= e and b >= s]
            far = [(min(abs(a - e), abs(b - s)), o) for o, a, b in own]
            best[d, f"k{k}"] = f"f{min(over)}" if over else f"f{min(far)[1]}" if far else "unknown"
    got = extract.nearest_fact(spark.createDataFrame(wanted, "doc_id long, key string, char_start int, char_end int"), spark.createDataFrame(facts, "doc_id long, fact string, ordinal int, char_start int, char_end int"))
    assert {(r["doc_id"], r["key"]): r["fact"] for r in got.collect()} == best
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_lists_of_replies_that_were_cut_off(spark):
    import json

    from clauseloom.operators import replies

    said = {
        1: '{"summary": "Many", "total_affirmative": 5, "obligations": [{"party": "A", "type": "affirmative"},{"party": "B"},{"party": "C", "description": "If termin',
        2: '{"executive_summary": "High risk", "overall_risk_rating": "high", "missing_protections": ["No FM"], "recommendations": [{"action": "x"}], "key_risks": [{"risk": "Unlimited"},{"risk": "No IP", "mitigation": "Add IP cl',
        3: '{"obligations": [{"text": "use { and } in strings"}, {"outer": {"inner": "val"}}, {"n": [1, 2,],}, {"cut',
        4: '{"obligations": [{"text": "say \\"hello\\" ]"}, {"b": "this is a long str',
        5: '{"obligations": [{"b": "cut',
        6: '```json\n{"obligations": [{"party": "whole"}],}\n```',
        7: "no json at all",
        8: None,
        9: "",
        10: '{"unknown_list": [{"a": 1}, {"b": 2',
        11: '{"obligations": [] , "key_risks": [{"risk": "second list"}], "x',
    }
    got: dict[int, list] = {}
    for r in replies.salvage_lists(spark.createDataFrame(list(said.items()), "id long, content string")).orderBy("id", "n").collect():
        got.setdefault(r["id"], [r["list"], r["singles"]]).append(json.loads(r["object"]))
    assert got == {
        1: ["obligations", {"summary": "Many", "total_affirmative": "5"}, {"party": "A", "type": "affirmative"}, {"party": "B"}],
        2: ["key_risks", {"executive_summary": "High risk", "overall_risk_rating": "high"}, {"risk": "Unlimited"}],
        3: ["obligations", {}, {"text": "use { and } in strings"}, {"outer": {"inner": "val"}}, {"n": [1, 2]}],
        4: ["obligations", {}, {"text": 'say "hello" ]'}],
        11: ["key_risks", {}, {"risk": "second list"}],
    }
