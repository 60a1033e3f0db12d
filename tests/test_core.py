"""The reference's operators: parity with Python's regular expressions, edge cases, and the SQL of every query."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clauseloom.functions import patterns as P
from clauseloom.functions import rules as R
from clauseloom.operators import assess, extract, replies
from clauseloom.plans import more_queries  # noqa: F401
from clauseloom.plans import queries as core
from clauseloom.sources import corpus as C
from clauseloom.streaming import incremental as I

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def same(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = same(df.select(*names).collect())
    theirs = same(duck.execute(f"SELECT {', '.join(names)} FROM ({core.SQL[name]})").fetchall())
    assert ours == theirs



def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


FLAGS = {P.DEFINITION: re.I | re.M, P.PARENTHETICAL: 0}


@pytest.mark.parametrize("rank", range(9))
def test_patterns_equal_python(spark, rank):
    """On random texts of awkward parts, offsets and groups are those of Python's ``re`` with the plain pattern."""
    regex = P.PATTERNS[rank][2]
    plain = regex[regex.index(")") + 1 :].replace(P.RUN, "")
    parts = ['"Fees"', " shall mean ", " means ", "x y.", "\n", "\r\n", "(the ", "(", ")", '"A b"', " or ", "'C'", "Section ", "§", "12.1", "(a)", "thirty (30) days", "90 ", "months", "$", "1,000.50", "USD", " dollars", "January 1, 2025", "2025-01-01", "1/2/2025", "5 %", "Acme Corp", ", a Texas corporation ", "Ltd.", " hereinafter called ", "hereafter ", " ", "é", " & ", ",", ".", " "]
    rng = random.Random(rank)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r["id"]: r["s"] for r in rows.select("id", P._spans_of(F.col("text"), *P.PATTERNS[rank]).alias("s")).collect()}
    for i, text in enumerate(texts):
        expected = []
        for m in re.finditer(plain, text, FLAGS.get(regex, re.I if rank not in (1, 6) else 0)):
            expected.append((m.start(), m.end()))
            if rank == 1 and m.group(2):
                expected.append((m.start(), m.end()))
        assert [(s["start"], s["stop"]) for s in found[i]] == expected, text


def test_overlaps_fold_over_the_last_kept_span(spark):
    def fold(spans):
        kept = []
        for s in spans:
            if kept and s[0] < kept[-1][1] and s[2] == kept[-1][2]:
                if s[1] - s[0] > kept[-1][1] - kept[-1][0]:
                    kept[-1] = s
            else:
                kept.append(s)
        return kept

    rng = random.Random(1)
    data = []
    for i in range(200):
        spans = sorted((a := rng.randint(0, 30), a + rng.randint(1, 12), rng.choice("xy")) for _ in range(rng.randint(0, 8)))
        data.append((i, [(a, 0, n, b, p, "", "", "") for n, (a, b, p) in enumerate(spans)]))
    rows = spark.createDataFrame(data, f"id int, s array<{P.SPAN}>").select("id", P.drop_overlaps(F.col("s")).alias("s")).collect()
    for r in rows:
        spans = [(x[0], x[3], x[4]) for x in dict(data)[r["id"]]]
        assert [(s["start"], s["stop"], s["pattern"]) for s in r["s"]] == fold(spans)


def test_long_text_is_linear(spark):
    rows = spark.createDataFrame([("The quick Brown fox, and Sons " * 3000,)], "text string")
    assert rows.select(F.size(P.extract_patterns(F.col("text"))).alias("n")).first()["n"] == 0


def test_rules(spark):
    rows = spark.createDataFrame([("1. Payment Terms", "Heading 2", 0.39, 4), ("SCOPE OF WORK", "Title", 0.95, 10), ("Definitions", "Normal", None, 16)], "h string, s string, c double, r int")
    got = [tuple(r) for r in rows.select(R.classify_heading(F.col("h")), R.section_number(F.col("h")), R.style_level(F.col("s")), R.confidence_label(F.col("c")), R.confidence_color(F.col("c")), R.risk_level(F.col("r"))).collect()]
    assert got == [("payment", "1", 2, "speculative", "red", "low"), ("scope", None, 0, "very_high", "blue", "high"), ("general", None, None, "unknown", "gray", "critical")]
    R.register(spark)
    assert tuple(spark.sql("SELECT classify_heading('1. Payment Terms'), confidence_label(0.5D), risk_level(9D), normalize_quotes('“a’')").first()) == ("payment", "low", "medium", "\"a'")


def test_term_chain_stops_at_cycles(spark):
    rows = spark.createDataFrame([(1, "A", "b"), (1, "B", "c"), (1, "C", "a"), (1, "D", "meaning")], "doc_id long, term string, resolves_to string")
    got = {r["term"]: (r["meaning"], r["hops"]) for r in extract.resolve_chain(rows).collect()}
    assert got == {"A": ("a", 3), "B": ("b", 3), "C": ("c", 3), "D": ("meaning", 1)}
    rows = spark.createDataFrame([(1, "A", "x"), (1, "a", "b"), (1, None, "n"), (1, "B", None), (1, "Z", "A")], "doc_id long, term string, resolves_to string")
    assert sorted((r["term"], r["meaning"], r["hops"]) for r in extract.resolve_chain(rows).collect()) == [("A", "x", 1), ("Z", "b", 2), ("a", "b", 1)]


def test_replies(spark):
    texts = [(1, '```json\n{"severity": "red", "n": [1, 2,],}\n```'), (2, "no json"), (3, None), (4, '{"items": [{"id": 1, "t": "a}b"}, {"id": 2}, {"id": 3, "t": "cut')]
    rows = spark.createDataFrame(texts, "id long, content string")
    got = {r["id"]: r["reply"] for r in replies.parse(rows, "severity string, n array<int>").collect()}
    assert tuple(got[1]) == ("red", [1, 2]) and got[2] is None and got[3] is None
    assert [(r["id"], r["n"], r["object"]) for r in replies.salvage(rows).where("id = 4").orderBy("n").collect()] == [(4, 0, '{"id": 1, "t": "a}b"}'), (4, 1, '{"id": 2}')]


def test_findings_with_replies(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    texts = spark.createDataFrame([(1, 0, "6. LAW", "governing_law", "Texas"), (1, 1, "5. I", "indemnification", "UNCAPPED INDEMNIFICATION applies")], "doc_id long, ordinal int, heading string, clause_type string, text string")
    said = spark.createDataFrame([(1, 0, "purple", 9, 3)], "doc_id long, ordinal int, severity string, risk_severity int, risk_likelihood int")
    got = {r["position"]: (r["severity"], r["score"]) for r in assess.findings(docs, texts, assess.playbook(spark), said).collect()}
    assert got["governing_law"] == ("yellow", 6) and got["indemnification"] == ("red", 20) and got["termination"] == ("red", 16)
    profile = assess.risk_profile(assess.findings(docs, texts, assess.playbook(spark), said)).first()
    assert (profile["score_sum"], profile["score_count"], profile["overall_level"]) == (90, 6, "high")


def test_triage_replies_do_not_outrank_a_failed_check(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    checks = spark.createDataFrame([(1, "problematic_provisions", "fail", "x"), (1, "term_duration", "review", "y")], "doc_id long, item_id string, status string, finding string")
    said = spark.createDataFrame([(1, "problematic_provisions", "pass"), (1, "term_duration", "pass"), (1, "remedies", "odd")], "doc_id long, item_id string, status string")
    got = {r["item_id"]: r["status"] for r in assess.triage_items(docs, checks, assess.checklist(spark), said).collect()}
    assert (got["problematic_provisions"], got["term_duration"], got["remedies"], got["definition_scope"]) == ("fail", "pass", "review", "review")


def test_incremental_batches_replace_their_own_rows(spark, tmp_path):
    schema = "id long, v string"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = I.run_available(stream, lambda b: b, ["id"], str(tmp_path / "state"))
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "a"), (2, "c")]


def test_empty_inputs(spark):
    docs = C.corpus(spark, SF).limit(0)
    p = C.paragraphs(docs)
    texts = extract.clause_texts(p, extract.clauses(p))
    for df in (extract.spans(docs), extract.bindings(docs), extract.cross_references(texts), assess.risk_profile(assess.findings(docs, texts, assess.playbook(spark)))):
        assert df.count() == 0


def test_first_tellers_meet_only_their_slots(spark):
    """Each slot is filled by its first fact; a fact that tells of none gives no row, and a null value tells of none."""
    facts = spark.createDataFrame([(1, 2, "Late fee"), (1, 1, "due in 30 DAYS"), (1, 0, "nothing"), (2, 0, None), (2, 1, "x")], "doc_id long, ordinal int, value string")
    found = {(r["doc_id"], r["fact_spec"]): r["filled_by"] for r in extract.first_tellers(facts, {"notice": ["notice", "days"], "fee": ["fee"], "schedule": ["due", "late"]}).collect()}
    assert found == {(1, "notice"): "due in 30 DAYS", (1, "fee"): "Late fee", (1, "schedule"): "due in 30 DAYS"}


def test_extraction_without_texts_stages_none(spark, monkeypatch):
    from clauseloom.operators import graph

    names, cells = [], spark.createDataFrame([], "doc_id long, row int, col int, text string")
    monkeypatch.setattr(graph, "staged", lambda df, name: names.append(name) or df)
    found = graph.complete(spark.createDataFrame([(1, True, "1. FEES\nUSD 5.")], "doc_id long, styled boolean, text string"), cells, texts=False)
    assert "clause-texts" not in names and not {"texts", "references", "slots"} & set(found)
