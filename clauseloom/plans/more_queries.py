"""Further queries: look-ups over facts, retrieval, records, replies and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..operators import assess, evaluate, extract, qa, replies, retrieval
from ..sources import corpus as C
from ..sources.store import staged
from ..streaming import incremental as I
from . import oracle as O
from .queries import SQL, _texts, query

#: Facts of all patterns, in order, overlaps dropped.
FACTS = O.KEPT + ", facts AS MATERIALIZED (SELECT doc_id, s.start AS char_start, s.stop AS char_end, s.rank AS rank, s.pattern AS pattern, s.value AS value, ordinal FROM kept_spans)"


def scanned(spark, d):
    """The corpus' spans, staged for queries that read them more than once."""
    return staged(extract.scan(C.corpus(spark, d)), "spans")


def facts(spark, d, docs=None):
    return extract.spans(C.corpus(spark, d) if docs is None else docs).select("doc_id", "ordinal", "char_start", "char_end", "rank", "value", "pattern")


@query(f"WITH {O.CLAUSES} SELECT c.doc_id, 'contract ' || c.doc_id AS title, CAST(len(list_filter(string_split_regex(c.text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count, CAST(coalesce(k.n, 0) AS BIGINT) AS clause_count, 'indexed' AS status FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id) k USING (doc_id)")
def a6_manifest(spark, d):
    docs = C.corpus(spark, d)
    n = extract.clauses(extract.outline(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("clause_count"))
    return docs.join(n, "doc_id", "left").select("doc_id", F.concat(F.lit("contract "), "doc_id").alias("title"), C.word_count(F.col("text")).alias("word_count"), F.coalesce("clause_count", F.lit(0)).alias("clause_count"), F.lit("indexed").alias("status"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, l_quantity AS size, l_returnflag || l_linestatus AS text FROM lineitem), m AS (SELECT doc_id, quantile_cont(size, 0.5) AS median FROM s GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT size), 'DESC')[1:4] AS tiers FROM s JOIN m USING (doc_id) WHERE size > median + 0.5 GROUP BY doc_id),
b AS (SELECT doc_id, block, avg(size) AS size, string_agg(text, '' ORDER BY size, text) AS text FROM s GROUP BY ALL)
SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(coalesce(CASE WHEN size > median + 0.5 AND tiers IS NOT NULL THEN CASE WHEN size >= tiers[1] - 0.3 THEN 1 WHEN size >= tiers[2] - 0.3 THEN 2 WHEN size >= tiers[3] - 0.3 THEN 3 WHEN size >= tiers[4] - 0.3 THEN 4 END END,
CASE WHEN length(text) BETWEEN 4 AND 60 THEN 2 END, -1) AS BIGINT) AS level FROM b JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)""")
def c6_c7_font_levels(spark, d):
    line = C.tables(spark, d, "lineitem")[0]
    spans = line.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("block"), F.lit(0).alias("line"), F.struct("l_quantity").alias("span"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("size"), F.lit(False).alias("bold"))
    return extract.font_levels(C.span_blocks(spans), spans).select("doc_id", "block", F.coalesce("level", F.lit(-1)).alias("level"))


_long = "concat(text, ' ', CAST(doc_id AS VARCHAR(20)), '. SCOPE OF WORK  one 7. TERM AND FEES 7.1 two, and then some more words so that this block is long')"
_start = extract.SECTION_START.replace("'", "''")


@query(f"""WITH {O.PARAS}, p AS (SELECT doc_id, {_long} AS text FROM paras WHERE idx = 0), m AS (SELECT doc_id, regexp_extract_all(text, '{_start}', 1) AS a, regexp_extract_all(text, '{_start}', 2) AS b FROM p)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS seq, a[i] || '. ' || trim(b[i]) AS text FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)""")
def c13_split_sections(spark, d):
    p = C.paragraphs(C.corpus(spark, d)).where("idx = 0").withColumn("text", F.expr(_long))
    return extract.split_sections(p).where("seq is not null").select("doc_id", "seq", "text")


@query(f"""WITH {O.TEXTS} SELECT o.doc_id, c.ordinal, CAST(count(*) AS BIGINT) AS n, string_agg(o.text, ' ' ORDER BY o.idx) AS body FROM owned o JOIN clauses c ON c.doc_id = o.doc_id AND c.idx = o.head AND NOT c.promoted WHERE o.idx <> o.head AND trim(o.text) <> '' GROUP BY o.doc_id, c.ordinal""")
def c16_clause_bodies(spark, d):
    p = C.paragraphs(C.corpus(spark, d))
    rows = extract.body_paragraphs(p, extract.clauses(p)).groupBy("doc_id", "ordinal")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("body"))


@query(f"WITH {O.CLAUSES} SELECT doc_id, ordinal, heading AS value, CAST(length(heading) AS BIGINT) AS char_end FROM clauses")
def d4_heading_facts(spark, d):
    return extract.heading_facts(extract.clauses(extract.outline(C.corpus(spark, d)))).drop("char_start")


@query(f"""WITH {O.CORPUS}, {FACTS}, {O.DEFINITIONS}, w AS (SELECT doc_id, lower(term) AS key, char_start, char_start + 5 AS char_end FROM definitions),
r AS (SELECT w.doc_id, key, value, ordinal, f.char_start <= w.char_end AND f.char_end >= w.char_start AS over, least(abs(f.char_start - w.char_end), abs(f.char_end - w.char_start)) AS far FROM w LEFT JOIN facts f USING (doc_id))
SELECT doc_id, key, coalesce(value, 'unknown') AS fact FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE WHEN over THEN 0 ELSE 1 END, CASE WHEN over THEN 0 ELSE far END, ordinal) = 1""")
def d8_nearest_fact(spark, d):
    return extract.nearest_held(C.corpus(spark, d), (0, 1), lambda s, i: s["value"])


@query(f"WITH {O.XREFS} SELECT doc_id, ordinal, CAST(count(*) AS BIGINT) AS n, string_agg(target_reference, ',' ORDER BY n) AS refs FROM xrefs GROUP BY doc_id, ordinal")
def e5_clause_reference_lists(spark, d):
    rows = extract.cross_references(_texts(spark, d)).groupBy("doc_id", "ordinal")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "target_reference"))), lambda x: x["target_reference"]), ",").alias("refs"))


@query(f"""WITH {O.SLOTS}, {FACTS}, k AS (SELECT s.doc_id, s.ordinal, s.fact_spec, arg_min(f.value, f.ordinal) FILTER (len(list_filter(r.keywords, lambda w: contains(lower(f.value), w))) > 0) AS filled_by
FROM slots s JOIN registry r USING (clause_type, fact_spec) JOIN facts f ON f.doc_id = s.doc_id GROUP BY ALL) SELECT * FROM k WHERE filled_by IS NOT NULL""")
def f4_filled_by(spark, d):
    return extract.held_tellers(extract.gathered(C.corpus(spark, d), chain=False))


@query(f"WITH {O.CORPUS}, {FACTS} SELECT doc_id, ordinal, value FROM facts WHERE rank = 2")
def g1_facts_by_type(spark, d):
    return facts(spark, d).where("pattern = 'section_reference'").select("doc_id", "ordinal", "value")


@query(f"WITH {O.CORPUS}, {FACTS} SELECT doc_id, ordinal, value FROM facts ORDER BY doc_id, ordinal LIMIT 1000 OFFSET 100")
def g2_facts_page(spark, d):
    return facts(spark, d).select("doc_id", "ordinal", "value").orderBy("doc_id", "ordinal").offset(100).limit(1000)


@query(f"WITH {O.CORPUS}, {FACTS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM facts GROUP BY doc_id")
def g3_fact_counts(spark, d):
    return facts(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.XREFS} SELECT c.doc_id, c.clause_type, CAST(count(*) AS BIGINT) AS n FROM xrefs x JOIN clauses c ON c.doc_id = x.doc_id AND c.ordinal = x.ordinal GROUP BY ALL")
def g5_references_by_clause(spark, d):
    texts = _texts(spark, d)
    return extract.cross_references(texts).join(texts.select("doc_id", "ordinal", "clause_type"), ["doc_id", "ordinal"]).groupBy("doc_id", "clause_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max(ts)::DATE::VARCHAR AS last_day, CAST(count(*) AS BIGINT) AS sessions FROM events GROUP BY user_id")
def g11_workspaces_by_access(spark, d):
    return C.tables(spark, d, "events")[0].groupBy("user_id").agg(F.max("ts").cast("date").cast("string").alias("last_day"), F.count(F.lit(1)).alias("sessions"))


@query(f"WITH {O.CORPUS}, {O.BINDINGS} SELECT doc_id, 'b:' || lower(term) AS source, 't:' || lower(resolves_to) AS target, 'resolves' AS relationship FROM bindings")
def h4_reduced_graph(spark, d):
    return extract.bindings(C.corpus(spark, d)).select("doc_id", F.concat(F.lit("b:"), F.lower("term")).alias("source"), F.concat(F.lit("t:"), F.lower("resolves_to")).alias("target"), F.lit("resolves").alias("relationship"))


NEAR = """p AS (SELECT a.vec_id AS query_id, a.label AS own, b.label AS label, b.vec_id AS id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 4) AS score
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) a CROSS JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)"""


def _near(spark, d, k):
    rows = C.tables(spark, d, "embeddings")[0].select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    found = retrieval.search(rows.where("id % 20 = 0"), rows, k)
    return found.join(rows.select("id", "label"), "id").join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")


@query(f"WITH {NEAR} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS kept FROM near WHERE rank <= 30 AND label = own QUALIFY kept <= 10")
def i4_filter_after_overfetch(spark, d):
    return assess.top_per(_near(spark, d, 30).where("label = own").withColumnRenamed("rank", "r"), "query_id", 10, "r").select("query_id", "id", F.col("rank").alias("kept"))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label <> 3 GROUP BY label")
def i7_index_counts(spark, d):
    rows = C.tables(spark, d, "embeddings")[0]
    gone = rows.where("label = 3").select("vec_id")
    return rows.join(gone, "vec_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {O.CORPUS}, {FACTS}, {O.BINDINGS}, x AS (SELECT doc_id, 0 AS a, 0 AS b, term || ' = ' || resolves_to AS line FROM bindings UNION ALL SELECT doc_id, 1, ordinal + 1, value FROM facts WHERE ordinal < 80)
SELECT doc_id, string_agg(line, chr(10) ORDER BY a, b, line) AS context FROM x GROUP BY doc_id""")
def i8_question_context(spark, d):
    return qa.held_context(extract.held(C.corpus(spark, d)))


@query("""WITH s AS (SELECT o_orderkey AS session_id, o_orderdate AS started_at, o_orderstatus, l_partkey AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
q AS (SELECT p_partkey AS query_id, unnest([p_partkey, p_partkey + 1]) AS doc_id FROM part), m AS (SELECT DISTINCT query_id, session_id, started_at FROM q JOIN s USING (doc_id) WHERE o_orderstatus = 'F')
SELECT query_id, session_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY started_at, session_id) AS BIGINT) AS rank FROM m""")
def j1_history(spark, d):
    orders, line, part = C.tables(spark, d, "orders", "lineitem", "part")
    ids = line.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.collect_set("l_partkey").alias("doc_ids"))
    sessions = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("active").alias("status"), F.lit("yes").alias("answer")).join(ids, "session_id")
    return qa.history(sessions, part.select(F.col("p_partkey").alias("query_id"), F.array("p_partkey", F.col("p_partkey") + 1).alias("doc_ids")))


@query("""WITH c AS (SELECT o_orderkey AS query_id, [o_orderkey % 300, 100000000 + o_orderkey, o_orderkey % 7] AS ids FROM orders), f AS (SELECT query_id, i, p_name, p_partkey FROM (SELECT query_id, unnest(ids) AS k, unnest([0, 1, 2]) AS i FROM c) LEFT JOIN part ON p_partkey = k)
SELECT query_id, CAST(greatest(count(p_name), 1) AS BIGINT) AS node_count, count(p_name) > 0 AS has_facts, coalesce(string_agg(p_name, '|' ORDER BY i) FILTER (p_name IS NOT NULL), 'Answer derived from document context') AS summaries FROM f GROUP BY query_id""")
def j3_j6_provenance(spark, d):
    orders, part = C.tables(spark, d, "orders", "part")
    answers = orders.select(F.col("o_orderkey").alias("query_id"), F.array(F.col("o_orderkey") % 300, F.col("o_orderkey") + 100000000, F.col("o_orderkey") % 7).alias("cited"))
    out = qa.provenance(answers, part.select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("value")).withColumn("fact_id", F.col("fact_id")))
    return out.select("query_id", "node_count", "has_facts", F.array_join(F.transform("nodes", lambda n: n["summary"]), "|").alias("summaries"))


@query("SELECT o_custkey AS query_id, CASE WHEN count(*) = 1 THEN 'single_document' ELSE 'repository' END AS scope FROM orders GROUP BY o_custkey")
def j7_query_scope(spark, d):
    return C.tables(spark, d, "orders")[0].groupBy(F.col("o_custkey").alias("query_id")).agg(F.collect_list("o_orderkey").alias("ids")).select("query_id", qa.scope(F.col("ids")).alias("scope"))


@query(f"""WITH {O.FINDINGS} SELECT doc_id, clause_type, 'Use our wording ' || doc_id AS proposed_language, CASE WHEN doc_id % 2 = 0 THEN 'tier_3' ELSE priority END AS priority FROM findings WHERE severity = 'red' AND position = clause_type AND doc_id % 3 > 0""")
def k11_redlines(spark, d):
    docs = C.corpus(spark, d)
    found = assess.findings(docs, _texts(spark, d), assess.playbook(spark)).select("doc_id", "clause_type", "severity")
    body = F.concat(F.lit('{"proposed_language": "'), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Use our wording "), "doc_id")).otherwise(""), F.lit('", "rationale": "risk", "priority": "'), F.when(F.col("doc_id") % 2 == 0, "tier_3").otherwise("urgent"), F.lit('",}'))
    said = replies.parse(found.select("doc_id", "clause_type", body.alias("content")), qa.REDLINE)
    return qa.redlines(said, assess.playbook(spark), found).select("doc_id", "clause_type", "proposed_language", "priority")


@query("SELECT user_id AS doc_id, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS total_affirmative, CAST(count(*) FILTER (event_id % 3 = 1) AS BIGINT) AS total_negative, CAST(7 AS BIGINT) AS total_conditional FROM events GROUP BY user_id")
def m4_obligations(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "affirmative").when(F.col("event_id") % 3 == 1, "negative").otherwise("conditional")
    each = C.tables(spark, d, "events")[0].select(F.col("user_id").alias("doc_id"), F.to_json(F.struct(kind.alias("type"), F.lit("Buyer").alias("party"))).alias("o"))
    said = each.groupBy("doc_id").agg(F.concat(F.lit('```json\n{"obligations": ['), F.array_join(F.collect_list("o"), ","), F.lit('], "total_conditional": 7}\n```')).alias("content"))
    return qa.obligations(replies.parse(said, qa.OBLIGATIONS))


@query("SELECT event_id AS id, CAST(n AS BIGINT) AS n, '{\"id\": ' || (event_id + n) || '}' AS object FROM events, (VALUES (0), (1)) v(n)")
def m2_salvaged_replies(spark, d):
    rows = C.tables(spark, d, "events")[0].select(F.col("event_id").alias("id"), F.concat(F.lit('{"facts": [{"id": '), "event_id", F.lit('}, {"id": '), F.col("event_id") + 1, F.lit('}, {"id": 3, "claim": "cut o')).alias("content"))
    return replies.salvage(rows)


@query(f"WITH acc AS ({SQL['n1_n3_keyword_accuracy']}) SELECT CAST(count(*) AS BIGINT) AS tasks, CAST(sum(right_n) AS BIGINT) AS right_n, CAST(sum(yes_n + no_n) AS BIGINT) AS n FROM acc")
def n4_overall_accuracy(spark, d):
    texts = C.corpus(spark, d).select((F.col("doc_id") % 4 > 1).alias("label"), "text")
    rows = evaluate.accuracy(evaluate.keyword_scores(texts, evaluate.tasks(spark)))
    return rows.agg(F.count(F.lit(1)).alias("tasks"), F.sum("right_n").alias("right_n"), F.sum(F.col("yes_n") + F.col("no_n")).alias("n"))


@query(f"WITH {O.CORPUS}, {O.DEFINITIONS} SELECT doc_id % 3 AS kind, CAST(count(*) FILTER (lower(term) = CASE doc_id % 3 WHEN 0 THEN 'agreement' WHEN 1 THEN 'fees' ELSE 'none' END) AS BIGINT) AS found FROM definitions GROUP BY 1")
def n5_definition_recall(spark, d):
    want = F.when(F.col("doc_id") % 3 == 0, "agreement").when(F.col("doc_id") % 3 == 1, "fees").otherwise("none")
    return extract.definition_bindings(C.corpus(spark, d)).groupBy((F.col("doc_id") % 3).alias("kind")).agg(F.count_if(F.lower("term") == want).alias("found"))


@query(f"WITH {O.CORPUS}, {FACTS}, {O.ALIASES} SELECT CAST(count(DISTINCT f.doc_id) AS BIGINT) AS with_facts, CAST((SELECT count(DISTINCT doc_id) FROM aliases) AS BIGINT) AS with_alias, CAST((SELECT count(*) FROM corpus) AS BIGINT) AS docs FROM facts f")
def n7_n8_coverage(spark, d):
    named = F.exists("bound", lambda b: b["naming"])  # an alias outranks definitions of its term, so none is hidden
    return extract.held(C.corpus(spark, d)).agg(F.count_if(F.size("facts") > 0).alias("with_facts"), F.count_if(named).alias("with_alias"), F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'non[- ]?compet|non[- ]?solicit|exclusiv(?:e|ity)') THEN 'fail' ELSE 'pass' END AS status FROM documents")
def p4_streamed_triage(spark, d):
    rule = "|".join(p for _, p in assess.PROBLEMS)
    return I.run_available(I.table_stream(spark, d, "documents"), lambda b: b.select("doc_id", F.when(F.col("text").rlike(rule), "fail").otherwise("pass").alias("status")), ["doc_id"])


@query(f"SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS n, {O.case([(f'l_linenumber * 3 <= {t}', v) for t, v in R.RISK[:-1]], 'critical')} AS level, {O.case([(f'l_tax < {t}', v) for t, v, _ in R.CONFIDENCE[:-1]], 'very_high')} AS label FROM lineitem")
def q2_sql_functions(spark, d):
    R.register(spark)
    rows = C.tables(spark, d, "lineitem")[0]
    out = spark.sql("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS n, risk_level(l_linenumber * 3D) AS level, confidence_label(l_tax) AS label FROM {rows}", rows=rows)
    R.unregister(spark)  # the plan has them resolved
    return out


@query(f"WITH {NEAR} SELECT query_id, CAST(count(*) FILTER (rank <= 10 AND label = own) AS BIGINT) AS hits, CAST(coalesce(min(rank) FILTER (label = own), -1) AS BIGINT) AS first, round(sum(CASE WHEN rank <= 10 AND label = own THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg FROM near WHERE rank <= 10 GROUP BY query_id")
def s1_ranking_measures(spark, d):
    return qa.ranking_measures(_near(spark, d, 10).withColumn("relevant", F.col("label") == F.col("own")), 10).na.fill(-1, ["first"])


@query("SELECT CAST(least(floor(l_discount * 10), 9) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS right_n FROM lineitem GROUP BY 1")
def s2_calibration(spark, d):
    return qa.calibration(C.tables(spark, d, "lineitem")[0].select(F.col("l_discount").alias("confidence"), (F.col("l_returnflag") == "R").alias("right")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0), f AS (SELECT parent AS root, child AS doc_id, 1 AS depth FROM e UNION ALL SELECT root, e.child, depth + 1 FROM f JOIN e ON e.parent = f.doc_id WHERE depth < 6)
SELECT root, doc_id, CAST(min(depth) AS BIGINT) AS depth FROM f GROUP BY root, doc_id""")
def s3_contract_family(spark, d):
    edges = C.tables(spark, d, "customer")[0].where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return qa.family(edges, 6)


@query("SELECT o_custkey AS family, o_orderpriority AS topic, o_orderkey AS doc_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_orderdate DESC, o_orderkey) = 1")
def s4_effective_terms(spark, d):
    rows = C.tables(spark, d, "orders")[0].withColumn("order", F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)).withColumn("place", F.struct("o_custkey", "o_orderpriority"))
    return assess.top_per(rows, "place", 1, F.desc("order"), F.desc("o_orderdate"), "o_orderkey").select(F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("doc_id"))
