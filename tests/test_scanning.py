"""The scan from literal keys holds what the column expressions find, and texts are dealt over tasks by their number."""

import random

import numpy as np
from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.functions.scanning import scanner
from clauseloom.operators import extract
from clauseloom.sources import corpus as C

PARTS = ['"Fees"', " shall mean ", " means ", "x y.", "\n", "\r\n", "(the ", "(", ")", '"A b"', " or ", "'C'", "Section ", "sEction", "§", "12.1", "(a)", "thirty (30) days", "90 ", "months", "$", "1,000.50", "USD", " dollars", "euro", "eur 5", "January 1, 2025", "2025-01-01", "1/2/2025", "5 %", "Acme Corp", ", a Texas corporation ", "Ltd.", " hereinafter called ", "hereafter ", " ", " & ", ",", ".", "x5days (30) days", "limited", "entity,", "\t", "\x1c", "'", '"', "(12) ", "week", "business  days", "é", "\x00"]


def test_scan_equals_column_expressions(spark):
    draw = random.Random(7)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(1, 28)))) for i in range(4000)]
    # an amount whose head another amount takes; a word of digits before another number's bracket
    rows += [(-1, None), (-2, ""), (-3, "eur 51,000.5090  dollars"), (-4, "5days (30) days"), (-5, "“Fees” means USD 5.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = docs.select("doc_id", P.normalize_quotes(F.col("text")).alias("t")).select("doc_id", P.spans_in(F.col("t")).alias("old"))
    both = old.join(extract.scan(docs), "doc_id").cache()
    assert both.count() == len(rows)
    assert both.agg(F.sum(F.size("old"))).first()[0] > 8000
    assert both.where("not (old <=> spans)").collect() == []


def test_parts_of_texts(spark):
    """Texts are cut before a digit that follows a stop and a line feed, unless a quote that closes a term may reach over the cut."""
    texts = ["1. A\nin 30 days.\n2. B", 'He said "so.\n3. C" means x.', '"Fees" is.\n4. "D" means y.\n5', "", "no. cut\n6"]
    begins = np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]])
    whole = "\0".join(texts)
    at = scanner((0,)).parts_of(whole, begins)
    ends = [*at[1:].tolist(), len(whole)]
    assert [whole[i:j].strip("\0") for i, j in zip(at.tolist(), ends)] == ["1. A\nin 30 days.\n", "2. B", texts[1], '"Fees" is.\n', '4. "D" means y.\n', "5", "", texts[4]]


def test_scan_of_equal_parts_equals_column_expressions(spark):
    """Wording that texts share, at other places of theirs, and after other numbers of the same pattern."""
    draw, shared = random.Random(9), ['1. T\n"Fees" means x (the "A" or "B").\n', "2 days.\n", '3. N (the "C") in 30 days.\n', "4 Acme Corp, a Texas company (Acme).\n", '5" means USD 5.\n', "no number.\n", '6 an open "term.\n']
    docs = spark.createDataFrame([(i, "".join(draw.choice(shared) for _ in range(draw.randint(0, 9)))) for i in range(1500)], "doc_id long, text string")
    old = docs.select("doc_id", P.normalize_quotes(F.col("text")).alias("t")).select("doc_id", P.spans_in(F.col("t")).alias("old"))
    both = old.join(extract.scan(docs), "doc_id").cache()
    assert both.count() == 1500 and both.where("not (old <=> spans)").collect() == []


def test_scan_leaves_no_ascii_text_to_the_expressions(spark):
    rows = spark.createDataFrame([(1, "due in 30 days"), (2, None), (3, "é 30 days"), (4, "30 days")], "doc_id long, t string").coalesce(1)
    found = rows.mapInArrow(scanner((3,)), f"doc_id long, t string, spans array<{P.SPAN}>").collect()
    assert {r["doc_id"]: None if r["spans"] is None else [(s["start"], s["a"], s["b"]) for s in r["spans"]] for r in found} == {1: [(7, "30", "days")], 2: [], 3: None, 4: [(0, "30", "days")]}


def test_texts_are_dealt_by_their_number(spark, monkeypatch):
    """Joined rows are few bytes, which Spark would put into one task; each task gets its share of texts all the same."""
    monkeypatch.setattr(C, "TEXTS_A_TASK", 100)
    docs = C.corpus(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 15 and sum(sizes) == 1500 and max(sizes) < 200
