"""The subpackage's queries against their SQL, and the pipeline stage by stage."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauseloom.llm import queries
from clauseloom.llm import mixing

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        path = f"{SF}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    show = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert show(df.select(*names).collect()) == show(db.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k < 3:
            assert docs.join(before, docs.columns, "left_semi").count() == seen[-1]  # whole rows of the stage before
            assert docs.select("doc_id").distinct().count() == seen[-1]
        if k == 1:
            assert docs.select("text").distinct().count() == seen[-1]
        if k == 3:
            rows = mixing.taken(before)
            assert docs.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0] == rows.selectExpr("sum(taken)").first()[0]
    assert 200 >= seen[0] >= seen[1] >= seen[2] > 100
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_with_repeats_null_and_equal_ids(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho".split()) for _ in range(n))
    a, b, c, d, e, f, g = (prose(60) for _ in range(7))
    long, short = prose(300), prose(8)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, a), (1, a), (2, a), (2, a), (3, b), (3, c), (None, d), (None, d), (None, e), (4, e), (5, f), (None, near(f)), (6, g), (7, near(g)), (None, ""), (8, None), (9, long), (9, short), (None, near(a)), (6, near(g) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    show = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    # quality: every row by the score of its own text
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    two = whole.where("doc_id < 120").withColumn("doc_id", F.expr("if(doc_id % 10 = 0, null, doc_id div 2)")).unionByName(whole).unionByName(whole.where("doc_id < 20"))
    model = corpus_pipeline.quality.train_quality(two, labels)
    scored = two.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("own"), "text").cache()
    passed = corpus_pipeline.quality.score_quality(scored, model).where(F.col("score") >= corpus_pipeline.quality.THRESHOLD).select("doc_id")
    wanted = scored.join(passed, "doc_id", "left_semi").select(F.col("own").alias("doc_id"), "text")
    assert show(corpus_pipeline.quality_classifier(spark, two, SF)) == show(wanted)
    # exact copies: one row of each text
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    kept = corpus_pipeline.exact_copies(spark, docs, SF)
    assert Counter((i, t or "") for i, t in show(kept).elements()) == Counter((None if i < 0 else i, t) for t, i in best.items())
    # near copies: one row of each group of rows
    kept.write.parquet(str(tmp_path / "exact"))
    kept = spark.read.parquet(str(tmp_path / "exact"))
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").split()] if w for k in range(max(1, len(w) - 4))}
    sets, group = [shingles(t) for _, t in left], list(range(len(left)))
    for x in range(len(left)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                group = [group[y] if k == group[x] else k for k in group]
    firsts = [sorted((i is None, i or 0) for (i, _), k in zip(left, group) if k == n)[0] for n in set(group)]
    near_kept = corpus_pipeline.near_copies(spark, kept, SF)
    assert Counter((i is None, i or 0) for i, _ in show(near_kept).elements()) == Counter(firsts)
    assert set(show(near_kept)) <= set(left) and max(show(near_kept).values()) == 1
    # mixing: each row as often as it is taken; the one source takes each of its rows once, repeats too
    assert show(corpus_pipeline.mix(spark, docs, SF)) == Counter((i, t) for i, t in rows if t)


def test_stages_on_empty_input(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
