"""Scalar rules: headings, clause types, references, confidence and risk."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import _let

#: Heading rules in order; the first that matches decides, else ``general``.
HEADINGS = [
    (r"\btermination\b", "termination"),
    (r"\bpayment\b|\bfees?\b|\bpricing\b|\bcompensation\b", "payment"),
    (r"\bconfidential\w*\b|\bnon-disclosure\b|\bnda\b", "confidentiality"),
    (r"\bindemnif\w*\b|\bindemnity\b", "indemnification"),
    (r"\bliabilit\w*\b|\blimitation\b", "liability"),
    (r"\bwarrant\w*\b|\brepresentation\b", "warranty"),
    (r"\bintellectual\s+property\b|\bip\s+rights\b|\bpatent\b|\bcopyright\b", "ip_rights"),
    (r"\bforce\s+majeure\b", "force_majeure"),
    (r"\bdispute\b|\barbitration\b|\bmediation\b", "dispute_resolution"),
    (r"\bgoverning\s+law\b|\bjurisdiction\b|\bchoice\s+of\s+law\b", "governing_law"),
    (r"\bnotices?\b|\bnotification\b", "notice"),
    (r"\bassignment\b|\btransfer\b", "assignment"),
    (r"\binsurance\b", "insurance"),
    (r"\bcompliance\b|\bregulat\w*\b", "compliance"),
    (r"\bdata\s+protection\b|\bprivacy\b|\bgdpr\b", "data_protection"),
    (r"\bnon-compete\b|\bnon-solicitation\b|\brestrict\w*\b", "non_compete"),
    (r"\bscope\s+of\b|\bdeliverables?\b", "scope"),
    (r"\bdefinition\b", "general"),
]
#: A reference's effect by the first group with a phrase in its context.
EFFECTS = [
    (["subject to", "conditional", "provided that", "unless"], "conditions"),
    (["notwithstanding", "override", "supersede", "prevail"], "overrides"),
    (["in accordance with", "pursuant to", "as specified in", "as set forth"], "incorporates"),
    (["except as", "other than", "excluding"], "limits"),
    (["as defined in", "defined in", "meaning given in"], "defines"),
]
#: A reference's type by the first word in it.
REFERENCE_TYPES = [("appendix", "appendix_ref"), ("schedule", "schedule_ref"), ("exhibit", "exhibit_ref"), ("annex", "annex_ref"), ("clause", "clause_ref"), ("article", "clause_ref")]
#: Upper ends of confidence bands (the last one is closed) with label and colour.
CONFIDENCE = [(0.40, "speculative", "red"), (0.60, "low", "orange"), (0.80, "moderate", "yellow"), (0.95, "high", "green"), (None, "very_high", "blue")]
#: Upper ends of risk scores with their level.
RISK = [(4, "low"), (9, "medium"), (15, "high"), (None, "critical")]


def _first(tests: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for test, value in tests:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def _literals(rule: str) -> list[str] | None:
    """For each of a rule's alternatives the letters that it must hold, or None where one has none at its head."""
    heads = [re.match(r"\\b([a-z-]{2,})([?*{]?)", part) for part in rule.split("|")]
    if re.search(r"[()\[\]]", rule) or not all(heads):
        return None
    return [h.group(1)[:-1] if h.group(2) else h.group(1) for h in heads]


def classify_heading(heading: Column, rules: list[tuple[str, str]] = HEADINGS) -> Column:
    """The kind of the first rule that matches. In a heading of ASCII alone a rule is tried only where its letters stand."""

    def test(rule, x):
        found, literals = x["text"].rlike("(?iUd)" + rule), _literals(rule)
        return found if literals is None else (~x["plain"] | reduce(Column.__or__, [F.contains(x["low"], F.lit(w)) for w in literals])) & found

    seen = F.struct(heading.alias("text"), F.lower(heading).alias("low"), (F.octet_length(heading) == F.length(heading)).alias("plain"))
    return _let(seen, lambda x: _first([(test(r, x), kind) for r, kind in rules], "general"))


def section_number(heading: Column) -> Column:
    found = F.regexp_extract(heading, r"(?Ud)^(\d+(?:\.\d+)*)\s*\.?\s+", 1)
    return F.when(found != "", found)


def style_level(style: Column) -> Column:
    """Title 0, Heading N gives N, anything else null."""
    return F.when(style == "Title", 0).when(style.startswith("Heading"), F.try_to_number(F.trim(F.regexp_extract(style, r"^Heading\s*(\d*)$", 1)), F.lit("999")).cast("int"))


def looks_like_heading(text: Column) -> Column:
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (t != "") & (F.length(t) <= 80) & (words <= 10) & ~(t.endswith(".") & ~F.substring(t, -2, 1).rlike(r"\d"))


def allcaps_heading(text: Column) -> Column:
    t = F.trim(text)
    words, letters = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")), F.regexp_replace(t, r"\P{L}", "")
    return F.length(t).between(4, 60) & (words <= 8) & (letters != "") & (letters == F.upper(letters))


def numbered_heading(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]") & (F.length(t) <= 80)


def structural_heading(text: Column) -> Column:
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    # lengths first, which cost little; a line feed may follow the sixty capitals
    return (F.length(t) < 80) & (t.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]") | ((F.length(t) <= 62) & t.rlike(r"^[A-Z][A-Z\s\-&/]{3,59}$") & (words <= 8)))


def reference_type(reference: Column) -> Column:
    return _first([(F.lower(reference).contains(w), kind) for w, kind in REFERENCE_TYPES], "section_ref")


def reference_effect(context: Column) -> Column:
    low = F.lower(context)
    return _first([(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), effect) for words, effect in EFFECTS], "references")


def _band(x: Column, which: int) -> Column:
    return _first([(x < row[0], row[which]) for row in CONFIDENCE[:-1]], CONFIDENCE[-1][which])


def confidence_label(x: Column) -> Column:
    """Null is ``unknown``; values outside 0..1 are no confidence and give null."""
    return F.when(x.isNull(), "unknown").when(x.between(0, 1), _band(x, 1))


def confidence_color(x: Column) -> Column:
    return F.when(x.isNull(), "gray").when(x.between(0, 1), _band(x, 2))


def risk_level(score: Column) -> Column:
    return _first([(score <= top, level) for top, level in RISK[:-1]], RISK[-1][1])


def register(spark) -> None:
    """SQL functions of the same names, as expressions: no Python runs per row."""
    cases = lambda rules, default: "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in rules) + f" ELSE '{default}' END"
    heads = cases([(f"heading RLIKE r'(?iUd){r}'", kind) for r, kind in HEADINGS], "general")
    bands = cases([(f"x < {top}D", label) for top, label, _ in CONFIDENCE[:-1]], CONFIDENCE[-1][1])
    levels = cases([(f"score <= {top}", level) for top, level in RISK[:-1]], RISK[-1][1])
    for made in (
        f"classify_heading(heading STRING) RETURNS STRING RETURN {heads}",
        f"confidence_label(x DOUBLE) RETURNS STRING RETURN CASE WHEN x IS NULL THEN 'unknown' WHEN x BETWEEN 0 AND 1 THEN {bands} END",
        f"risk_level(score DOUBLE) RETURNS STRING RETURN {levels}",
        "normalize_quotes(t STRING) RETURNS STRING RETURN translate(t, '“”„‘’‚–—«»', '\"\"\"\\'\\'\\'--\"\"')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}")


#: Every match of a pattern with its place, as a table function: one scan marks the matches, running lengths give the places.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_SPANS = f"""spans(t STRING, pattern STRING) RETURNS TABLE (n INT, start INT, stop INT, match STRING) RETURN
SELECT CAST(pos - 1 AS INT), CAST(at AS INT), CAST(at + length(substring_index(part, '{_CLOSE}', 1)) AS INT), substring_index(part, '{_CLOSE}', 1) FROM (
  SELECT pos, part, aggregate(slice(parts, 1, pos), 0, (a, x) -> a + length(x)) - greatest(pos - 1, 0) AS at FROM (SELECT parts, posexplode(parts) AS (pos, part) FROM (
    SELECT split(regexp_replace(translate(t, '{_OPEN}{_CLOSE}', '\ufffd\ufffd'), pattern, '{_OPEN}$0{_CLOSE}'), '{_OPEN}', -1) AS parts))) WHERE pos > 0"""


def register_spans(spark) -> None:
    """``spans(text, pattern)`` for ``FROM docs, LATERAL spans(text, pattern)``: rows (n, start, stop, match)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_SPANS}")


def unregister(spark) -> None:
    """Take the session's functions of ``register`` and ``register_spans`` away again."""
    for name in ("classify_heading", "confidence_label", "risk_level", "normalize_quotes", "spans"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
