"""Playbook review with risk, and NDA triage, as joins and conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.patterns import _let

#: Playbook positions (key, clause type, priority, required, escalation triggers).
PLAYBOOK = [
    ("limitation_of_liability", "limitation_of_liability", "tier_1", True, ["Uncapped liability", "No consequential damages exclusion", "Asymmetric liability carveouts", "Unlimited indemnification"]),
    ("indemnification", "indemnification", "tier_1", True, ["Unilateral indemnification obligations", "Uncapped indemnification", "Indemnification for 'any breach'", "Indemnification survives termination indefinitely"]),
    ("ip_ownership", "ip_rights", "tier_1", False, ["Vendor retains all IP rights", "No license to pre-existing IP", "IP assignment without compensation"]),
    ("data_protection", "data_protection", "tier_1", True, ["No data protection obligations", "No breach notification requirement", "Unlimited data retention", "No sub-processor restrictions"]),
    ("confidentiality", "confidentiality", "tier_2", True, ["No confidentiality obligations", "Unilateral confidentiality", "Perpetual confidentiality without carve-outs"]),
    ("termination", "termination", "tier_2", True, ["No termination for convenience", "Unilateral termination rights", "No cure period for breach", "Auto-renewal without opt-out"]),
    ("governing_law", "governing_law", "tier_2", False, ["Foreign jurisdiction governing law", "Exclusive jurisdiction in vendor's home court", "Waiver of jury trial without arbitration"]),
    ("force_majeure", "force_majeure", "tier_3", False, ["No force majeure clause", "Unilateral force majeure", "Force majeure includes economic hardship"]),
    ("assignment", "assignment", "tier_3", False, ["Unrestricted assignment rights", "Assignment without notice", "No anti-assignment clause"]),
    ("payment_terms", "payment", "tier_2", False, ["Payment due on receipt", "Prepayment required", "Late payment interest exceeding 1.5% per month", "No right to dispute invoices"]),
]
#: Default scores of findings without a risk score, by severity.
DEFAULT_SCORE = {"red": (12, "high"), "yellow": (6, "medium"), "green": (2, "low")}
#: The checklist (item, name, automation, critical).
CHECKLIST = [
    ("agreement_structure", "Agreement Structure", "hybrid", False),
    ("definition_scope", "Definition Scope", "hybrid", False),
    ("receiving_party_obligations", "Receiving Party Obligations", "llm_only", False),
    ("standard_carveouts", "Standard Carveouts", "hybrid", True),
    ("permitted_disclosures", "Permitted Disclosures", "llm_only", False),
    ("term_duration", "Term and Duration", "hybrid", False),
    ("return_destruction", "Return/Destruction", "llm_only", False),
    ("remedies", "Remedies", "llm_only", False),
    ("problematic_provisions", "Problematic Provisions", "hybrid", True),
    ("governing_law", "Governing Law", "hybrid", False),
]
#: Patterns of the five carve-outs, in order, and of provisions that fail a text.
CARVEOUTS = [
    ("public_knowledge", r"public(?:ly)?\s+(?:available|known|knowledge)"),
    ("prior_possession", r"prior\s+(?:possession|knowledge|to\s+disclosure)"),
    ("independent_development", r"independent(?:ly)?\s+develop"),
    ("third_party_receipt", r"(?:third\s+party|received\s+from)"),
    ("legal_compulsion", r"(?:law|court\s+order|legal(?:ly)?\s+(?:compel|requir))"),
]
PROBLEMS = [("non-compete", r"non[- ]?compet"), ("non-solicitation", r"non[- ]?solicit"), ("exclusivity", r"exclusiv(?:e|ity)")]
TERM, LAW, MUTUAL = r"(\d+)\s*(?:year|yr|month|mo)", r"govern(?:ed|ing)\s+(?:by\s+)?(?:the\s+)?law", r"mutual|each\s+party|both\s+parties"
#: Of each pattern the words (in lower case) without one of which it matches nowhere.
WORDS = {p: [w] for (_, p), w in zip(CARVEOUTS + PROBLEMS, ("public", "prior", "independent", "", "", "compet", "solicit", "exclusiv"))}
WORDS |= {CARVEOUTS[3][1]: ["third", "received"], CARVEOUTS[4][1]: ["law", "court", "legal"], TERM: ["year", "yr", "mo"], LAW: ["govern"], MUTUAL: ["mutual", "each", "both"]}
#: Routing and timeline by level.
ROUTING = {
    "red": ("Full legal review required — critical issues found", "3-5 business days"),
    "yellow": ("Counsel review recommended — non-critical issues found", "1-2 business days"),
    "green": ("Approve and route for signature", "Same day"),
}


def playbook(spark: SparkSession, positions=PLAYBOOK) -> DataFrame:
    return spark.createDataFrame(positions, "position string, clause_type string, priority string, required boolean, triggers array<string>")


def checklist(spark: SparkSession, items=CHECKLIST) -> DataFrame:
    return spark.createDataFrame(items, "item_id string, name string, automation string, critical boolean")


def findings(docs: DataFrame, texts: DataFrame, positions: DataFrame, replies: DataFrame | None = None, focus: list[str] | None = None, have: Column | None = None) -> DataFrame:
    """One finding per matched clause and per required position without a clause; with ``focus``, for these clause types only.

    A trigger in the clause text makes it red at 5 x 4; a missing required clause is red at 4 x 4; else a reply of the model
    (doc_id, ordinal, severity, risk_severity, risk_likelihood) decides, with yellow and 2 x 2 in place of bad values; no
    reply leaves the clause green without a score. The playbook is a short list, so it is the side that is broadcast. ``have``: of
    documents that hold them in their rows, the types of their clauses; then no text is shuffled to tell what is missing.
    """
    small = F.broadcast(positions if focus is None else positions.where(F.col("clause_type").isin(*focus)))
    low = F.lower("text")
    matched = texts.join(small, "clause_type").withColumn("trigger", F.get(F.filter("triggers", lambda t: F.contains(low, F.lower(t))), F.lit(0)))
    if replies is None:
        matched = matched.withColumn("severity", F.lit("green")).withColumn("s", F.lit(None).cast("int")).withColumn("l", F.lit(None).cast("int"))
    else:
        ok = lambda c: F.when(F.col(c).between(1, 5), F.col(c)).otherwise(2)
        reply = replies.select("doc_id", "ordinal", F.when(F.lower("severity").isin("green", "yellow", "red"), F.lower("severity")).otherwise("yellow").alias("severity"), ok("risk_severity").cast("int").alias("s"), ok("risk_likelihood").cast("int").alias("l"))
        matched = matched.join(reply, ["doc_id", "ordinal"], "left").withColumn("severity", F.coalesce("severity", F.lit("green")))
    hit = F.col("trigger").isNotNull()
    found = matched.select("doc_id", "position", "clause_type", "priority", F.col("ordinal").alias("clause"), F.when(hit, "red").otherwise(F.col("severity")).alias("severity"), F.when(hit, 5).otherwise(F.col("s")).alias("risk_severity"), F.when(hit, 4).otherwise(F.col("l")).alias("risk_likelihood"), "trigger")
    if have is None:
        known = docs.select("doc_id").join(texts.groupBy("doc_id").agg(F.collect_set("clause_type").alias("have")), "doc_id", "left")
    else:
        known = docs.select("doc_id", have.alias("have"))
    gone = known.join(small.where("required")).where(~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), F.col("clause_type")))
    gone = gone.select("doc_id", "position", "clause_type", "priority", F.lit(None).cast("int").alias("clause"), F.lit("red").alias("severity"), F.lit(4).alias("risk_severity"), F.lit(4).alias("risk_likelihood"), F.lit(None).cast("string").alias("trigger"))
    return found.unionByName(gone).withColumn("score", F.col("risk_severity") * F.col("risk_likelihood"))


def risk_profile(findings: DataFrame) -> DataFrame:
    """Per document: distribution of levels, sum and number of scores, their mean to one place, level, highest finding, counts."""
    default = F.create_map(*[F.lit(x) for k, (v, _) in DEFAULT_SCORE.items() for x in (k, v)])
    level = F.create_map(*[F.lit(x) for k, (_, v) in DEFAULT_SCORE.items() for x in (k, v)])
    rows = findings.withColumn("points", F.coalesce("score", default[F.col("severity")])).withColumn("level", F.when(F.col("score").isNotNull(), R.risk_level(F.col("score"))).otherwise(level[F.col("severity")]))
    # the first of the highest scores: positions by clause, missing ones last, then by name
    order = F.struct(F.coalesce("score", F.lit(0)), -F.coalesce("clause", F.lit(1_000_000)))
    out = rows.groupBy("doc_id").agg(
        *[F.count_if(F.col("level") == x).alias(x) for _, x in R.RISK],
        F.sum("points").alias("score_sum"),
        F.count(F.lit(1)).alias("score_count"),
        F.max(order).alias("top"),
        F.count_if(F.col("severity") == "red").alias("tier_1_issues"),
        F.count_if(F.col("severity") == "yellow").alias("tier_2_issues"),
    )
    mean = F.col("score_sum") / F.col("score_count")
    return out.withColumn("overall_score", F.bround(mean, 1)).withColumn("overall_level", R.risk_level(mean)).drop("top")


def highest_findings(findings: DataFrame, positions: list[tuple] = PLAYBOOK) -> DataFrame:
    """(doc_id, position, clause, score): each document's finding of the highest score, of equal ones the first by the
    playbook's order and then the clause's. Findings without a score are none; documents with such alone give no row."""
    place = F.create_map(*[F.lit(x) for k, p in enumerate(positions) for x in (p[0], k)])
    best = F.max_by(F.struct("position", "clause", "score"), F.struct("score", -place[F.col("position")], -F.coalesce("clause", F.lit(0))))
    return findings.where("score > 0").groupBy("doc_id").agg(best.alias("f")).select("doc_id", "f.*")


def finding_provenance(findings: DataFrame, clause_facts: DataFrame) -> DataFrame:
    """Findings with ``fact_ids`` (their clause's heading fact, then those it contains) and the heading's offsets; a finding about
    a missing clause has no ids and zeros. ``clause_facts``: (doc_id, ordinal, fact_ids, char_start, char_end)."""
    known = clause_facts.select("doc_id", F.col("ordinal").alias("clause"), "fact_ids", "char_start", "char_end")
    none = F.array().cast("array<string>")
    return findings.join(known, ["doc_id", "clause"], "left").withColumn("fact_ids", F.coalesce("fact_ids", none)).na.fill(0, ["char_start", "char_end"])


def review_summary(findings: DataFrame) -> DataFrame:
    """Per document: counts by severity, the missing clauses in order, and the strategy told without a model."""
    out = findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == x).alias(x) for x in ("green", "yellow", "red")],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("clause").isNull(), F.col("clause_type")))), ",").alias("missing"),
    )
    red = F.when(F.col("red") > 0, F.format_string("Tier 1 (Must-fix): %d RED issues require immediate attention.", "red"))
    yellow = F.when(F.col("yellow") > 0, F.format_string("Tier 2 (Negotiate): %d YELLOW issues should be addressed.", "yellow"))
    return out.withColumn("strategy", F.when((F.col("red") == 0) & (F.col("yellow") == 0), "All clauses align with playbook positions. No negotiation needed.").otherwise(F.concat_ws(" ", red, yellow)))


def triage_checks(docs: DataFrame, texts: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, status, finding): the items that text alone decides, from the lower-cased text and the clause types.
    Documents that tell the heading of their first clause of governing law as ``law`` need no ``texts``."""
    if texts is not None:
        docs = docs.join(texts.where("clause_type = 'governing_law'").groupBy("doc_id").agg(F.min_by("heading", "ordinal").alias("law")), "doc_id", "left")
    item = lambda name, ok, bad, good, else_: F.struct(F.lit(name).alias("item_id"), F.when(ok, "pass").otherwise(bad).alias("status"), F.when(ok, good).otherwise(else_).alias("finding"))
    named = lambda tests: F.filter(F.array(*[F.when(test, F.lit(n)) for n, test in tests]), lambda x: x.isNotNull())

    def seen(t):
        """What the text tells, each pattern looked for once, and only where words stand of which it must hold one."""
        word = lambda pattern: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in WORDS[pattern]])
        there = lambda pattern: word(pattern) & t.rlike(pattern)
        term = F.when(word(TERM), F.regexp_extract(t, TERM, 0)).otherwise("")
        return F.struct(there(MUTUAL).alias("mutual"), named([(n, ~there(p)) for n, p in CARVEOUTS]).alias("lacking"), named([(n, there(p)) for n, p in PROBLEMS]).alias("wrong"), term.alias("term"), F.col("law").alias("law"), (F.col("law").isNotNull() | there(LAW)).alias("governed"))

    def items(x):
        return F.array(
            item("agreement_structure", x["mutual"], "review", F.lit("Mutual NDA detected"), F.lit("May be unilateral — review recommended")),
            item("standard_carveouts", F.size(x["lacking"]) == 0, "fail", F.lit("All 5 standard carveouts present: " + ", ".join(n for n, _ in CARVEOUTS)), F.concat(F.lit("Missing carveouts: "), F.array_join(x["lacking"], ", "))),
            item("term_duration", x["term"] != "", "review", F.concat(F.lit("Term duration found: "), x["term"]), F.lit("No explicit term duration found — manual review recommended")),
            item("problematic_provisions", F.size(x["wrong"]) == 0, "fail", F.lit("No non-compete, non-solicitation, or exclusivity provisions found"), F.concat(F.lit("Problematic provisions detected: "), F.array_join(x["wrong"], ", "))),
            item("governing_law", x["governed"], "review", F.when(x["law"].isNotNull(), F.concat(F.lit("Governing law clause found: "), x["law"])).otherwise("Governing law reference found in text"), F.lit("No governing law clause identified")),
        )

    return docs.select("doc_id", F.inline(_let(F.lower(text_col), lambda t: _let(seen(t), items))))


def triage_items(docs: DataFrame, checks: DataFrame, items: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """All checklist items of each document. A failed check stands; else the model's reply (doc_id, item_id, status), with
    review for a status unknown; without a reply the check, or review where there is none."""
    rows = docs.select("doc_id").join(F.broadcast(items)).join(checks, ["doc_id", "item_id"], "left")
    reply = F.lit(None).cast("string")
    if replies is not None:
        known = replies.select("doc_id", "item_id", F.when(F.lower("status").isin("pass", "fail", "review", "n/a"), F.lower("status")).otherwise("review").alias("reply"))
        rows, reply = rows.join(known, ["doc_id", "item_id"], "left"), F.col("reply")
    status = F.when(F.col("status") == "fail", "fail").otherwise(F.coalesce(reply, F.col("status"), F.lit("review")))
    return rows.select("doc_id", "item_id", "name", "critical", status.alias("status"), F.coalesce("finding", F.lit("")).alias("finding"))


def triage(items: DataFrame) -> DataFrame:
    """Per document: level, routing, timeline, counts, key issues and the summary line."""
    failed = F.col("status") == "fail"
    out = items.groupBy("doc_id").agg(F.bool_or(failed & F.col("critical")).alias("hard"), F.bool_or(failed).alias("soft"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "review")], F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin("fail", "review"), F.col("item_id")))), ",").alias("issues"))
    out = out.withColumn("level", F.when(F.col("hard"), "red").when(F.col("soft"), "yellow").otherwise("green"))
    routing, timeline = (F.create_map(*[F.lit(x) for k, v in ROUTING.items() for x in (k, v[i])])[F.col("level")] for i in (0, 1))
    out = out.withColumn("routing", routing).withColumn("timeline", timeline)
    line = F.format_string("NDA Triage: %d items evaluated — %d PASS, %d FAIL, %d REVIEW. Classification: %s. Routing: %s", "total", "n_pass", "n_fail", "n_review", F.upper("level"), "routing")
    return out.withColumn("summary", line).drop("hard", "soft", "total")


def compare_clauses(texts: DataFrame, left: DataFrame, term: str, limit: int = 8000) -> DataFrame:
    """(left_id, right_id, left_text, right_text) for document pairs ``left``: texts of clauses whose type holds ``term``."""
    some = texts.where(F.contains("clause_type", F.lit(term))).groupBy("doc_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]), "\n\n"), F.lit(limit)).alias("text"))
    one = some.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"))
    two = some.select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"))
    return left.join(one, "left_id").join(two, "right_id")


def latest(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("s")).select(key, "s.*")


def top_per(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
