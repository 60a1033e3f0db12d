"""Queries over manifests, provenance, look-ups, sources and rule tables that a user supplies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rules as R
from ..operators import assess, extract, graph, qa, retrieval
from ..sources import corpus as C
from ..sources.store import VersionedTables, shared_folder, staged
from . import oracle as O
from .graph_queries import ALL, BODIES
from .more_queries import FACTS, facts
from .queries import _texts, query

_PATH = "concat('in/contract ', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 5 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.txt' ELSE '.pdf' END)"


@query(f"""{ALL}, i AS (SELECT doc_id, text, doc_id % 5 <> 1 AND doc_id % 13 <> 4 AS fine FROM corpus),
f AS (SELECT doc_id, count(*) AS n FROM every_fact GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM bindings GROUP BY doc_id), a AS (SELECT doc_id, string_agg(DISTINCT entity, '|' ORDER BY entity) AS parties FROM aliases GROUP BY doc_id)
SELECT doc_id, 'contract ' || doc_id AS title, CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'txt' ELSE 'pdf' END AS file_format, sha256(CASE WHEN doc_id % 13 = 4 THEN '' ELSE text END) AS file_hash,
CAST(CASE WHEN fine THEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) ELSE 0 END AS BIGINT) AS word_count, CAST(CASE WHEN fine THEN coalesce(f.n, 0) ELSE 0 END AS BIGINT) AS fact_count, CAST(CASE WHEN fine THEN coalesce(c.n, 0) ELSE 0 END AS BIGINT) AS clause_count,
CAST(CASE WHEN fine THEN coalesce(b.n, 0) ELSE 0 END AS BIGINT) AS binding_count, CASE WHEN fine THEN coalesce(parties, '') ELSE '' END AS parties, CASE WHEN doc_id % 5 = 1 THEN 'error: unsupported format: .txt' WHEN NOT fine THEN 'error: no text' ELSE 'indexed' END AS status
FROM i LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)""")
def a6_manifest_with_errors(spark, d):
    """Files of three kinds, some without text: all are listed, the bad ones with their error."""
    docs = C.corpus(spark, d).withColumn("path", F.expr(_PATH)).withColumn("text", F.when(F.col("doc_id") % 13 != 4, F.col("text")))
    known, unknown = C.documents_with_format(docs, "path")
    unknown = unknown.withColumn("file_format", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumnRenamed("reason", "error")
    good, blank = known.where("text is not null and trim(text) <> ''"), known.where("text is null or trim(text) = ''").withColumn("error", F.lit("no text"))
    columns = ["doc_id", "path", "file_format", "text"]
    found = graph.complete(good, C.cells(spark, d).join(good.select("doc_id"), "doc_id", "left_semi"), texts=False)
    out = graph.manifest(good.select(*columns), blank.select(*columns, "error").unionByName(unknown.select(*columns, "error")), found)
    return out.withColumn("parties", F.array_join("parties", "|"))


@query(f"""{ALL}, f AS (SELECT doc_id, count(*) AS n FROM every_fact GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM bindings GROUP BY doc_id)
SELECT doc_id, CAST(signed AS VARCHAR) AS signed, CAST(coalesce(f.n, 0) AS BIGINT) AS facts, CAST(coalesce(c.n, 0) AS BIGINT) AS clauses, CAST(coalesce(b.n, 0) AS BIGINT) AS bindings FROM corpus LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)""")
def g6_contracts_with_counts(spark, d):
    docs = C.corpus(spark, d)
    x = graph.complete(docs, C.cells(spark, d), texts=False)
    return graph.counts(docs, facts=x["facts"], clauses=x["clauses"], bindings=x["bindings"]).join(docs.select("doc_id", F.col("signed").cast("string").alias("signed")), "doc_id")


_own = """r AS (SELECT doc_id, ordinal, -1 AS idx, heading AS text, 'h:' || ordinal AS id FROM clauses UNION ALL SELECT doc_id, ordinal, idx, text, 't:' || idx FROM bodies2),
ids AS (SELECT doc_id, ordinal, string_agg(id, ',' ORDER BY idx) AS fact_ids, max(length(text)) FILTER (idx = -1) AS char_end FROM r GROUP BY doc_id, ordinal)"""


@query(f"""WITH {O.FINDINGS}, {BODIES}, {_own} SELECT f.doc_id, position, severity, coalesce(clause, -1) AS clause, coalesce(fact_ids, '') AS fact_ids, CAST(0 AS BIGINT) AS char_start, CAST(coalesce(char_end, 0) AS BIGINT) AS char_end
FROM findings f LEFT JOIN ids i ON i.doc_id = f.doc_id AND i.ordinal = f.clause""")
def k10_finding_provenance(spark, d):
    docs = C.corpus(spark, d)
    p = C.paragraphs(docs)
    clauses = staged(extract.clauses(p), "clauses")
    found = assess.findings(docs, extract.clause_texts(p, clauses), assess.playbook(spark))
    out = assess.finding_provenance(found, graph.clause_fact_texts(clauses, extract.body_paragraphs(p, clauses)))
    return out.select("doc_id", "position", "severity", F.coalesce("clause", F.lit(-1)).alias("clause"), F.array_join("fact_ids", ",").alias("fact_ids"), "char_start", "char_end")


_order = ", ".join(f"('{p[0]}', {k})" for k, p in enumerate(assess.PLAYBOOK))


@query(f"WITH {O.FINDINGS}, o AS (SELECT * FROM (VALUES {_order}) o(position, place)) SELECT doc_id, position, coalesce(clause, -1) AS clause, CAST(score AS BIGINT) AS score FROM findings JOIN o USING (position) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, coalesce(clause, 0)) = 1")
def k7_highest_findings(spark, d):
    return assess.highest_findings(assess.findings(C.corpus(spark, d), _texts(spark, d), assess.playbook(spark))).na.fill(-1, ["clause"])


_focus = ["indemnification", "termination", "data_protection"]


@query(f"WITH {O.FINDINGS} SELECT doc_id, position, coalesce(clause, -1) AS clause, severity FROM findings WHERE clause_type IN ({', '.join(map(O.quote, _focus))})")
def k1_focused_findings(spark, d):
    return assess.findings(C.corpus(spark, d), _texts(spark, d), assess.playbook(spark), focus=_focus).select("doc_id", "position", F.coalesce("clause", F.lit(-1)).alias("clause"), "severity")


@query(f"""WITH {O.FINDINGS}, m AS (SELECT doc_id, position, clause, trigger, (doc_id + clause) % 6 AS k FROM matched)
SELECT doc_id, position, clause, CASE WHEN trigger IS NOT NULL THEN 'red' ELSE CASE k WHEN 0 THEN 'green' WHEN 1 THEN 'red' WHEN 5 THEN 'green' ELSE 'yellow' END END AS severity, CAST(CASE WHEN trigger IS NOT NULL THEN 20 WHEN k = 0 THEN 2 * 3 WHEN k = 1 THEN 25 WHEN k IN (2, 3) THEN 4 WHEN k = 4 THEN 2 ELSE -1 END AS BIGINT) AS score FROM m""")
def k5_replied_findings(spark, d):
    """The model's replies vary: good ones, unknown severities, scores out of range or missing, and none at all."""
    texts = staged(_texts(spark, d), "clause-texts")
    k = (F.col("doc_id") + F.col("ordinal")) % 6
    said = texts.where(k < 5).select("doc_id", "ordinal", F.when(k == 0, "Green").when(k == 1, "RED").when(k == 2, "purple").when(k == 3, "").otherwise("yellow").alias("severity"), F.when(k == 0, 2).when(k == 1, 5).when(k == 2, 9).when(k == 4, 1).alias("risk_severity"), F.when(k == 0, 3).when(k == 1, 5).when(k == 2, 0).alias("risk_likelihood"))
    found = assess.findings(C.corpus(spark, d), texts, assess.playbook(spark), said).where("clause is not null")
    return found.select("doc_id", "position", "clause", "severity", F.coalesce("score", F.lit(-1)).alias("score"))


@query(f"""WITH {O.XREFS} SELECT doc_id, ordinal, n, 'h:' || ordinal AS source_fact_id, 'x:' || ordinal || ':' || n AS reference_id, (SELECT string_agg('x:' || y.ordinal || ':' || y.n, ',' ORDER BY y.n) FROM xrefs y WHERE y.doc_id = x.doc_id AND y.ordinal = x.ordinal) AS of_clause FROM xrefs x""")
def e5_linked_references(spark, d):
    texts = staged(_texts(spark, d), "clause-texts")
    linked, clauses = graph.linked_references(staged(extract.cross_references(texts), "references"), texts)
    return linked.join(clauses.select("doc_id", "ordinal", F.array_join("reference_ids", ",").alias("of_clause")), ["doc_id", "ordinal"]).select("doc_id", "ordinal", "n", "source_fact_id", "reference_id", "of_clause")


@query("""SELECT o_orderkey AS query_id, array_to_string(list_transform(range(o_orderkey % 4), lambda i: CASE (o_orderkey + i) % 5 WHEN 0 THEN 'Fact' WHEN 1 THEN 'Binding' WHEN 2 THEN 'Inference' WHEN 3 THEN 'External Source' ELSE 'Unknown' END), ',') AS labels, o_orderkey % 4 AS node_count,
len(list_filter(range(o_orderkey % 4), lambda i: (o_orderkey + i) % 5 = 0)) > 0 AS has_facts, len(list_filter(range(o_orderkey % 4), lambda i: (o_orderkey + i) % 5 = 2)) > 0 AS has_inferences FROM orders""")
def j6_shown_provenance(spark, d):
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("fact", "binding", "inference", "external", "odd")))
    nodes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < k % 4), lambda i: F.struct(F.get(kinds, ((k + i) % 5).cast("int")).alias("node_type"), i.cast("string").alias("reference_id")))
    out = qa.shown_provenance(C.tables(spark, d, "orders")[0].select(k.alias("query_id"), nodes.alias("nodes")))
    return out.withColumn("labels", F.array_join("labels", ","))


@query(f"WITH {O.CORPUS} SELECT doc_id, doc_id % 2 = 0 AS label, replace(text, chr(10), ' ') AS text FROM corpus")
def a10_labelled_lines(spark, d):
    """Written as tab-separated lines with a head, and read back as labelled text."""
    folder = shared_folder(spark, "labelled")
    rows = C.corpus(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("No").alias("answer"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    rows.write.option("sep", "\t").option("header", True).option("escapeQuotes", True).option("quoteAll", True).option("escape", '"').csv(folder)
    return C.labelled_tsv(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("answer") == "Yes").alias("label"), "text")


@query("SELECT 'contract ' || o_orderkey || '.docx' AS filename, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'pdf' ELSE 'docx' END AS format, lower(o_orderstatus) || ',k' || o_orderkey % 7 AS tags FROM orders")
def a11_sample_manifests(spark, d):
    """Manifests of 500 samples each, every one a file that holds one JSON list, read back together."""
    folder, k = shared_folder(spark, "manifests"), F.col("o_orderkey")
    one = F.struct(F.concat(F.lit("contract "), k, F.lit(".docx")).alias("filename"), F.col("o_orderpriority").alias("title"), F.when(k % 3 == 0, "pdf").otherwise("docx").alias("format"), F.array(F.lower("o_orderstatus"), F.concat(F.lit("k"), k % 7)).alias("tags"))
    C.tables(spark, d, "orders")[0].groupBy(F.floor(k / 500).alias("part")).agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("part").text(folder)
    return C.sample_manifest(spark, f"{folder}/part=*").select("filename", "title", "format", F.array_join("tags", ",").alias("tags"))


#: A user's own rules: headings, facts that a clause should hold, and words that tell of them.
_RULES = [(r"\bdefinitions\b", "glossary"), (r"\bpayment\b|\btermination\b", "money and end")]
_FACTS = [("glossary", "terms", True), ("money and end", "price", False), ("money and end", "breach", True)]
_WORDS = [("terms", ["shall mean"]), ("price", ["usd", "invoices"]), ("breach", ["for breach"])]
_own_type = O.case([(f"regexp_matches(text, {O.quote('(?i)' + r)})", k) for r, k in _RULES], "general")
_own_specs = ", ".join(f"('{t}', '{s}', {str(r).lower()}, [{', '.join(map(O.quote, dict(_WORDS)[s]))}])" for t, s, r in _FACTS)


@query(f"""WITH {O.TEXTS.replace(O.HEADING, _own_type)}, registry AS (SELECT * FROM (VALUES {_own_specs}) r(clause_type, fact_spec, required, keywords))
SELECT doc_id, ordinal, clause_type, fact_spec, required, CASE WHEN len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0 THEN 'partial' ELSE 'missing' END AS status FROM texts JOIN registry USING (clause_type)""")
def q1_own_rules(spark, d):
    p = C.paragraphs(C.corpus(spark, d))
    texts = extract.clause_texts(p, extract.clauses(p, _RULES))
    slots = spark.createDataFrame(_FACTS, "clause_type string, fact_spec string, required boolean")
    return extract.fact_slots(texts, slots, spark.createDataFrame(_WORDS, "fact_spec string, keywords array<string>"))


@query(f"WITH {O.CORPUS}, s AS ({O.spans(2)}) SELECT doc_id, n, char_start AS start, char_start + size AS stop, match FROM s")
def q2_spans_in_sql(spark, d):
    R.register_spans(spark)
    out = spark.sql(f"SELECT doc_id, s.* FROM {{docs}}, LATERAL spans(text, r'{P.SECTION}') s", docs=C.corpus(spark, d).select("doc_id", "text"))
    R.unregister(spark)  # the plan has it resolved
    return out


#: Tables that keys are looked up in: source, document id, second key, value.
_SEVEN = {
    "contracts": ("orders", "o_orderkey", "o_custkey", "o_orderstatus"),
    "facts": ("lineitem", "l_orderkey", "l_linenumber", "l_partkey"),
    "bindings": ("lineitem", "l_orderkey", "l_linenumber", "l_returnflag"),
    "inferences": ("orders", "o_orderkey", "o_custkey", "o_orderpriority"),
    "slots": ("lineitem", "l_orderkey", "l_linenumber", "l_linestatus"),
    "workspaces": ("customer", "c_custkey", "c_nationkey", "c_mktsegment"),
    "sessions": ("events", "event_id", "user_id", "event_type"),
}
_KEYS = [1, 7, 77, 770]


@query(" UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST({doc} AS BIGINT) AS doc_id, CAST({key} AS BIGINT) AS part, CAST({value} AS VARCHAR) AS value FROM {table} WHERE {doc} IN ({', '.join(map(str, _KEYS))})" for name, (table, doc, key, value) in _SEVEN.items()))
def g7_pruned_look_ups(spark, d):
    """Seven tables in buckets of their id; a look-up opens the files of its keys' buckets, sorted by id inside."""
    tables = {name: C.tables(spark, d, table)[0].select(F.col(doc).cast("long").alias("doc_id"), F.col(key).cast("long").alias("part"), F.col(value).cast("string").alias("value")) for name, (table, doc, key, value) in _SEVEN.items()}
    store = VersionedTables(spark, shared_folder(spark, "g7"), {name: ["doc_id", "part"] for name in _SEVEN})
    store.commit(1, tables)
    shape = tables["facts"].schema
    found = [store.look_up(name, shape, _KEYS).select(F.lit(name).alias("table_name"), "doc_id", "part", "value") for name in _SEVEN]
    return reduce(DataFrame.unionByName, found)


_edges = "SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey % 5 = 0"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_edges}) WHERE child > 0), f AS (SELECT parent AS root, child AS doc_id, 1 AS depth FROM e UNION SELECT root, e.child, depth + 1 FROM f JOIN e ON e.parent = f.doc_id)
SELECT root, doc_id, CAST(min(depth) AS BIGINT) AS depth FROM f GROUP BY root, doc_id""")
def s3_whole_families(spark, d):
    """Families of any depth, with documents that have two parents."""
    rows = C.tables(spark, d, "customer")[0].where("c_custkey > 0")
    one = lambda df, by: df.select(F.col("c_custkey").cast("long").alias("child"), F.floor(F.col("c_custkey") / by).alias("parent"))
    return qa.family(one(rows, 3).unionByName(one(rows.where("c_custkey % 5 = 0"), 2)))


@query(f"WITH {O.CORPUS}, {FACTS} SELECT doc_id, 'fact' AS chunk_type, '[characters ' || char_start || '-' || char_end || '] ' || value AS text FROM facts WHERE length(trim(value)) >= 5")
def i1_fact_chunks(spark, d):
    return retrieval.fact_chunks(facts(spark, d))


@query(f"""{ALL} SELECT doc_id, fact_id AS node, 'fact' AS kind, left(value, 80) AS label FROM every_fact UNION ALL SELECT doc_id, 'k:' || ordinal, 'clause', heading FROM clauses UNION ALL SELECT doc_id, 'b:' || lower(term), 'binding', term || ' → ' || resolves_to FROM bindings""")
def h4_reduced_nodes(spark, d):
    x = graph.complete(C.corpus(spark, d), C.cells(spark, d), texts=False)
    return graph.reduced_nodes(x["clauses"], x["facts"], x["bindings"])


_hay = """ordered AS (SELECT doc_id, 0 AS kind, ordinal AS a, 0 AS b, value FROM facts UNION ALL SELECT doc_id, 1, row, col, text FROM cells WHERE trim(text) <> '' UNION ALL SELECT doc_id, 2, rank, char_start, entity FROM aliases
UNION ALL SELECT doc_id, 3, ordinal, 0, heading FROM clauses UNION ALL SELECT doc_id, 4, idx, 0, text FROM bodies2),
hay AS MATERIALIZED (SELECT doc_id, string_agg(value, ' ' ORDER BY kind, a, b, value) AS text FROM ordered GROUP BY doc_id)"""
_checks = O.CHECKS.split(", law AS (", 1)[1].replace("FROM corpus LEFT JOIN law", "FROM hay LEFT JOIN law")


@query(f"{ALL}, {_hay}, law AS ({_checks} SELECT doc_id, item_id, status, finding FROM checks")
def l1_l6_checks_of_facts(spark, d):
    """Triage over what was extracted from a document instead of its text."""
    return assess.triage_checks(graph.held_haystacks(extract.gathered(C.corpus(spark, d)), C.cell_rows(spark, d)))


@query(f"""WITH {O.CLAUSES}, {FACTS}, f AS (SELECT doc_id, string_agg('- [p:' || ordinal || '] (characters ' || char_start || '-' || char_end || '): ' || left(value, 200), chr(10) ORDER BY ordinal) AS facts_text FROM facts WHERE ordinal < 50 GROUP BY doc_id),
c AS (SELECT doc_id, string_agg('- [k:' || ordinal || '] ' || clause_type || ': ' || heading, chr(10) ORDER BY ordinal) AS clauses_text FROM clauses GROUP BY doc_id)
SELECT doc_id, coalesce(facts_text, '') AS facts_text, coalesce(clauses_text, '') AS clauses_text FROM f FULL JOIN c USING (doc_id)""")
def m6_triage_prompts(spark, d):
    return qa.held_triage_prompts(extract.gathered(C.corpus(spark, d), chain=False))


@query("SELECT user_id, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS cleared, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS left_rows FROM events GROUP BY user_id")
def g11_cleared_sessions(spark, d):
    """Sessions of a list are cleared; by workspace, how many went and how many are left."""
    rows = C.tables(spark, d, "events")[0].select("user_id", "event_id")
    gone = rows.where("event_id % 3 = 0").select("event_id", F.lit(True).alias("gone"))
    marked = rows.join(gone, "event_id", "left")
    return marked.groupBy("user_id").agg(F.count_if("gone").alias("cleared"), F.count_if(F.col("gone").isNull()).alias("left_rows"))
