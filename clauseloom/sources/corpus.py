"""Input tables: the derived contract corpus, its paragraphs and cells, positioned spans, manifests and labelled text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One contract per order. Only syntax that both Spark and DuckDB read, so that both engines see the same bytes.
CORPUS_SQL = """
SELECT o_orderkey AS doc_id, o_orderkey % 4 <> 3 AS styled, o_custkey AS owner, CAST(o_orderdate AS DATE) AS signed,
concat(
 CASE WHEN o_orderkey % 2 = 0 THEN 'MASTER SERVICES AGREEMENT' ELSE 'MUTUAL NON-DISCLOSURE AGREEMENT' END, chr(10),
 'This Agreement is between Acme ', r_name, ' Corp, a Texas corporation ("Supplier") and Buyer ', c_mktsegment,
 ' Ltd, hereinafter referred to as "Buyer".', chr(10),
 CASE WHEN o_orderkey % 3 = 0 THEN concat('It is called (the "Agreement" or "Contract").', chr(10)) ELSE '' END,
 '1. DEFINITIONS', chr(10), '"Fees" shall mean USD ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)), ' payable under Section 2.', chr(10),
 '"Charges" means Fees.', chr(10),
 '2. PAYMENT TERMS', chr(10), 'Subject to Section 3.1, invoices are due in thirty (30) days with interest of 2 %.', chr(10),
 CASE WHEN o_orderkey % 5 <> 0 THEN concat('3. TERMINATION', chr(10), 'Either party may end this on ',
   CASE o_orderkey % 3 WHEN 0 THEN '30' WHEN 1 THEN '60' ELSE '90' END, ' days written notice from ',
   CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), ' for breach.', chr(10)) ELSE '' END,
 '4. CONFIDENTIALITY', chr(10), 'No duty covers what is publicly known, in prior possession or independently developed',
 CASE WHEN o_orderkey % 4 > 0 THEN ', received from others' ELSE '' END,
 CASE WHEN o_orderkey % 4 > 1 THEN ', required by court order' ELSE '' END,
 CASE WHEN o_orderkey % 2 = 0 THEN ' for 24 months' ELSE '' END, '.', chr(10),
 CASE WHEN o_orderkey % 7 = 0 THEN concat('5. INDEMNIFICATION', chr(10), 'Uncapped indemnification applies under Clause 4.', chr(10)) ELSE '' END,
 CASE WHEN o_orderkey % 3 <> 0 THEN concat('6. GOVERNING LAW', chr(10), 'The courts of Texas decide.', chr(10)) ELSE '' END,
 CASE WHEN o_orderkey % 11 = 0 THEN 'A non-compete binds both sides with exclusivity.' ELSE 'Nothing else is agreed.' END
) AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


#: Texts that one task makes and searches: a few seconds' work.
TEXTS_A_TASK = 20_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, styled, owner, signed, text) by the SQL above, without leaving names behind in the session's catalog.

    Rows are joined while they are narrow and then dealt by their key over tasks in proportion to their number: left to their
    bytes, a few tasks may get all texts. What is grouped by document afterwards finds its rows together.
    """
    orders, customer, nation, region = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // TEXTS_A_TASK))
    head, sources = CORPUS_SQL.rsplit("FROM ", 1)
    sources = re.sub(r"\b(orders|customer|nation|region)\b", r"{\1}", sources)
    columns = "o_orderkey, o_custkey, o_totalprice, o_orderdate, c_mktsegment, r_name"
    rows = spark.sql(f"SELECT {columns} FROM {sources}", orders=orders, customer=customer, nation=nation, region=region)
    return spark.sql(f"{head} FROM {{rows}}", rows=rows.repartition(tasks, "o_orderkey"))


def documents_with_format(docs: DataFrame, path_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose path ends in .docx or .pdf, with their format, and the rejected rest with a reason."""
    suffix = F.lower(F.regexp_extract(path_col, r"\.([^./]+)$", 1))
    ok = suffix.isin("docx", "pdf")
    return docs.where(ok).withColumn("file_format", suffix), docs.where(~ok).withColumn("reason", F.concat(F.lit("unsupported format: ."), suffix))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, idx, text, style, char_start, char_end): lines of each text; a non-empty one is followed by one separator.

    Numbered lines of styled texts are headings. Offsets are running sums over a document's lines, which cost nothing where
    they are not read; documents that are dealt by their key stay where they are.
    """
    rows = docs.select("doc_id", "styled", F.posexplode(F.split(text_col, "\n")).alias("idx", "text"))
    heading = F.col("styled") & F.col("text").rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]")
    before = F.sum(F.length("text") + (F.length("text") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("doc_id", "idx", "text", F.when(heading, "Heading1").alias("style"), F.coalesce(before, F.lit(0)).cast("int").alias("char_start"))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text"))


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with ``lines``, the paragraphs of each text (idx, text, style) as one array, for what is found inside the row."""
    line = lambda x, i: F.struct(i.alias("idx"), x.alias("text"), F.when(F.col("styled") & x.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]"), "Heading1").alias("style"))
    return docs.select(*[c for c in docs.columns if c not in ("styled", text_col)], F.transform(F.split(text_col, "\n"), line).alias("lines"))


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row, values): the rows of each contract's table but the header, one per line item."""
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    return lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), F.array("p_name", F.col("l_quantity").cast("long").cast("string"), F.col("l_shipdate").cast("date").cast("string")).alias("values"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row, col, text): one table per contract, a header row and one row per line item."""
    rows = cell_rows(spark, sf_dir)
    head = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row"), F.array(F.lit("Part"), F.lit("Quantity"), F.lit("Ship date")).alias("values"))
    return head.unionByName(rows).select("doc_id", "row", F.posexplode("values").alias("col", "text"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Cells that become facts: not the header row, not blank; offsets in reading order, one separator after each."""
    kept = cells.where((F.col("row") > 0) & (F.trim("text") != ""))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("row", "col", "text").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    return kept.select("doc_id", "row", "col", "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"), F.format_string("body > table[0] > row[%d] > cell[%d]", "row", "col").alias("structural_path"))


def span_blocks(spans: DataFrame) -> DataFrame:
    """Positioned spans (doc_id, page, block, line, span, text, size, bold) joined to one row per block."""
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"), F.sum("size").alias("sizes"), F.count(F.lit(1)).alias("n"), F.bool_and("bold").alias("bold"))
    return lines.groupBy("doc_id", "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " ").alias("text"), (F.sum("sizes") / F.sum("n")).alias("size"), F.bool_and("bold").alias("bold"))


def word_count(text):
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated lines under a head; a field in quotes may hold tabs, and a doubled quote in it is one."""
    return spark.read.csv(path, sep="\t", header=True, escape='"')


def sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
