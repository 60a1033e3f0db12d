"""SQL for DuckDB that the queries are held against: common table expressions for the corpus and what is derived from it."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import rules as R
from ..operators import assess, extract
from ..sources.corpus import CORPUS_SQL


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def regex(pattern: str) -> str:
    """A pattern in RE2's dialect: its flags, and none of the run rule that only backtracking engines need."""
    flags = "(?im)" if pattern.startswith("(?iUdm)") else "(?i)" if pattern.startswith("(?iUd)") else ""
    return quote(flags + pattern[pattern.index(")") + 1 :].replace(P.RUN, ""))


def case(tests: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{v}'" for t, v in tests) + f" ELSE '{default}' END"


HEADING = case([(f"regexp_matches(text, {quote('(?i)' + r)})", k) for r, k in R.HEADINGS], "general")
NUMBERED, CAPS = r"'^\d+(\.\d+)*\.?\s+[A-Z]'", r"'^[A-Z][A-Z\s\-&/]{3,59}$'"
CORPUS = f"corpus AS ({CORPUS_SQL})"
PARAS = f"""{CORPUS}, lines AS (SELECT doc_id, styled, string_split(text, chr(10)) AS l FROM corpus),
paras AS (SELECT doc_id, styled, unnest(l) AS text, unnest(range(len(l))) AS idx FROM lines)"""
CLAUSES = f"""{PARAS}, heads AS (
  SELECT doc_id, idx, text AS heading, {HEADING} AS clause_type, nullif(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s*\\.?\\s+', 1), '') AS section_number, NOT styled AS promoted
  FROM paras WHERE (styled AND regexp_matches(text, {NUMBERED})) OR (NOT styled AND (regexp_matches(text, {NUMBERED}) AND length(text) < 80 OR regexp_matches(text, {CAPS}) AND len(string_split_regex(text, '\\s+')) <= 8))
), clauses AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS ordinal FROM heads)"""
TEXTS = f"""{CLAUSES}, owned AS (
  SELECT doc_id, idx, text, max(CASE WHEN styled AND regexp_matches(text, {NUMBERED}) THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS head FROM paras
), bodies AS (SELECT doc_id, head, string_agg(text, ' ' ORDER BY idx) AS text FROM owned WHERE head IS NOT NULL AND trim(text) <> '' GROUP BY doc_id, head),
texts AS (SELECT c.doc_id, c.ordinal, c.heading, c.clause_type, c.section_number, coalesce(b.text, '') AS text FROM clauses c LEFT JOIN bodies b ON b.doc_id = c.doc_id AND b.head = c.idx AND NOT c.promoted)"""


def spans(rank: int, source: str = "corpus") -> str:
    """A select of (doc_id, rank, n, char_start, char_end, match, g1, g2) for one pattern."""
    r = regex(P.PATTERNS[rank][2])
    groups = 2 if rank in (0, 1, 7, 8) else 3 if rank == 3 else 1 if rank == 2 else 0
    g = [f"regexp_extract_all(text, {r}, {k})" for k in range(groups + 1)]
    extra = ", ".join(f"{x} AS m{k}" for k, x in enumerate(g))
    first, second = {0: ("NULL", "NULL"), 1: ("m1[i]", "NULL"), 2: ("m1[i]", "m2[i]"), 3: ("m2[i]", "m3[i]")}[groups]
    return f"""SELECT doc_id, {rank} AS rank, i - 1 AS n, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m0[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS char_start,
      length(m0[i]) AS size, m0[i] AS match, CAST({first} AS VARCHAR) AS g1, CAST({second} AS VARCHAR) AS g2
    FROM (SELECT *, unnest(range(1, len(m0) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, {r}) AS gap, {extra} FROM {source}))"""


def _all_spans() -> str:
    parts = []
    for rank, (name, _, _, group) in enumerate(P.PATTERNS):
        skip = "length(regexp_extract(match, '^[\\s&.,]*', 0))" if rank in (7, 8) else "0"
        value = "substring(match, " + skip + " + 1)" if rank in (7, 8) else "match" if group == 0 else "trim(g1)" if rank == 1 else "g1"
        a, b = {0: ("g1", "trim(g2)"), 1: ("trim(g1)", "NULL"), 2: ("g1", "NULL"), 3: ("g1", "g2"), 7: ("trim(g1)", "trim(g2)"), 8: ("trim(g1)", "trim(g2)")}.get(rank, ("NULL", "NULL"))
        row = "SELECT doc_id, struct_pack(start := char_start + %s, stop := char_start + size, rank := %d, n := %s, pattern := '%s', value := %s, a := CAST(%s AS VARCHAR), b := CAST(%s AS VARCHAR)) AS s FROM (%s)"
        parts.append(row % (skip, rank, "2 * n" if rank == 1 else "n", name, value, a, b, spans(rank)))
        if rank == 1:
            parts.append(row % ("0", 1, "2 * n + 1", name, "trim(g2)", "trim(g2)", "NULL", spans(rank)) + " WHERE coalesce(trim(g2), '') <> ''")
    return " UNION ALL ".join(parts)


#: All spans of all patterns, and those that are left when the overlaps are dropped, one span after the other.
KEPT = f"""every_span AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s.start, s.rank, s.n) AS k FROM ({_all_spans()})),
fold(doc_id, k, kept) AS (SELECT doc_id, k, [s] FROM every_span WHERE k = 1 UNION ALL
  SELECT f.doc_id, o.k, CASE WHEN o.s.start < f.kept[-1].stop AND o.s.pattern = f.kept[-1].pattern THEN CASE WHEN o.s.stop - o.s.start > f.kept[-1].stop - f.kept[-1].start THEN list_append(f.kept[1:len(f.kept) - 1], o.s) ELSE f.kept END ELSE list_append(f.kept, o.s) END
  FROM fold f JOIN every_span o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
kept_spans AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ordinal, kept[i] AS s FROM (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT doc_id, arg_max(kept, k) AS kept FROM fold GROUP BY doc_id)))"""
ALIASES = f"""found AS ({spans(7)} UNION ALL {spans(8)}), aliases AS (
  SELECT doc_id, trim(g2) AS alias, trim(g1) AS entity, char_start, rank FROM found WHERE trim(g1) <> '' AND trim(g2) <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(g2)) ORDER BY rank, char_start) = 1)"""
DEFINITIONS = f"""quoted AS ({spans(0)}), held AS ({spans(1)}), held2 AS (
  SELECT h.*, trim(substring(c.text, greatest(char_start - 120, 0) + 1, char_start - greatest(char_start - 120, 0))) AS before FROM held h JOIN corpus c USING (doc_id)
), terms AS (
  SELECT doc_id, trim(g1) AS term, trim(g2) AS resolves_to, 0 AS rank, char_start, n FROM quoted
  UNION ALL SELECT doc_id, trim(g1), coalesce(nullif(right(before, 100), ''), '(parenthetical definition)'), 1, char_start, 2 * n FROM held2
  UNION ALL SELECT doc_id, trim(g2), coalesce(nullif(right(before, 100), ''), '(parenthetical definition)'), 1, char_start, 2 * n + 1 FROM held2 WHERE coalesce(trim(g2), '') <> ''
), definitions AS (SELECT doc_id, term, resolves_to, rank, char_start FROM terms WHERE term <> '' AND resolves_to <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY rank, char_start, n) = 1)"""
BINDINGS = f"""{ALIASES}, {DEFINITIONS}, bindings AS (
  SELECT doc_id, term, resolves_to, kind, char_start FROM (
    SELECT doc_id, alias AS term, entity AS resolves_to, 'alias' AS kind, 0 AS prior, char_start FROM aliases
    UNION ALL SELECT doc_id, term, resolves_to, 'definition', 1, char_start FROM definitions)
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY prior, char_start) = 1)"""

_context = "substring(t.text, greatest(s.char_start - 80, 0) + 1, s.char_start + s.size + 80 - greatest(s.char_start - 80, 0))"
_effect = case([(" OR ".join(f"contains(lower(context), '{w}')" for w in words), effect) for words, effect in R.EFFECTS], "references")
_type = case([(f"contains(lower(target_reference), '{w}')", kind) for w, kind in R.REFERENCE_TYPES], "section_ref")
XREFS = f"""{TEXTS}, keyed AS (SELECT doc_id * 100 + ordinal AS doc_id, text FROM texts), refs AS ({spans(2, 'keyed')}),
raw AS (SELECT t.doc_id, t.ordinal, s.n, s.match AS target_reference, s.g1 AS number, {_context} AS context FROM refs s JOIN texts t ON s.doc_id = t.doc_id * 100 + t.ordinal),
targets AS (SELECT doc_id, section_number AS number, max(ordinal) AS target_ordinal FROM texts WHERE section_number IS NOT NULL GROUP BY ALL),
xrefs AS (SELECT r.doc_id, r.ordinal, r.n, number, target_reference, {_type} AS reference_type, {_effect} AS effect, trim(context) AS context, target_ordinal, target_ordinal IS NOT NULL AS resolved FROM raw r LEFT JOIN targets USING (doc_id, number))"""

_specs = ", ".join(f"('{t}', '{s}', {str(r).lower()}, [{', '.join(quote(k) for k in extract.KEYWORDS[s])}])" for t, s, r in extract.REGISTRY)
_told = f"""len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0
  OR (fact_spec IN ({', '.join(map(quote, extract.BY_DURATION))}) AND regexp_matches(text, {regex(P.DURATION)}))
  OR (fact_spec IN ({', '.join(map(quote, extract.BY_MONEY))}) AND regexp_matches(text, {regex(P.MONETARY)}))"""
SLOTS = f"""{TEXTS}, registry AS (SELECT * FROM (VALUES {_specs}) r(clause_type, fact_spec, required, keywords)),
slots AS (SELECT doc_id, ordinal, clause_type, fact_spec, required, CASE WHEN {_told} THEN 'partial' ELSE 'missing' END AS status FROM texts JOIN registry USING (clause_type))"""

_positions = ", ".join(f"('{p}', '{c}', '{t}', {str(r).lower()}, [{', '.join(quote(x) for x in triggers)}])" for p, c, t, r, triggers in assess.PLAYBOOK)
_level = case([(f"score <= {top}", level) for top, level in R.RISK[:-1]], R.RISK[-1][1])
FINDINGS = f"""{TEXTS}, positions AS (SELECT * FROM (VALUES {_positions}) p(position, clause_type, priority, required, triggers)),
matched AS (SELECT doc_id, position, clause_type, priority, ordinal AS clause, list_filter(triggers, lambda x: contains(lower(text), lower(x)))[1] AS trigger FROM texts JOIN positions USING (clause_type)),
findings AS (
  SELECT doc_id, position, clause_type, priority, clause, CASE WHEN trigger IS NULL THEN 'green' ELSE 'red' END AS severity, CASE WHEN trigger IS NOT NULL THEN 20 END AS score, trigger FROM matched
  UNION ALL SELECT doc_id, position, clause_type, priority, NULL, 'red', 16, NULL FROM corpus CROSS JOIN positions p
  WHERE required AND NOT EXISTS (SELECT 1 FROM texts t WHERE t.doc_id = corpus.doc_id AND t.clause_type = p.clause_type))"""

_has = lambda p: f"regexp_matches(lower(text), {quote(p)})"
_lack = "list_filter([" + ", ".join(f"CASE WHEN NOT {_has(p)} THEN '{n}' END" for n, p in assess.CARVEOUTS) + "], lambda x: x IS NOT NULL)"
_wrong = "list_filter([" + ", ".join(f"CASE WHEN {_has(p)} THEN '{n}' END" for n, p in assess.PROBLEMS) + "], lambda x: x IS NOT NULL)"
CHECKS = f"""{CLAUSES}, law AS (SELECT doc_id, arg_min(heading, ordinal) AS law FROM clauses WHERE clause_type = 'governing_law' GROUP BY doc_id),
seen AS (SELECT doc_id, text, law, {_lack} AS lacking, {_wrong} AS wrong, regexp_extract(lower(text), {quote(assess.TERM)}, 0) AS term FROM corpus LEFT JOIN law USING (doc_id)),
checks AS (
  SELECT doc_id, 'agreement_structure' AS item_id, CASE WHEN {_has(assess.MUTUAL)} THEN 'pass' ELSE 'review' END AS status, CASE WHEN {_has(assess.MUTUAL)} THEN 'Mutual NDA detected' ELSE 'May be unilateral — review recommended' END AS finding FROM seen
  UNION ALL SELECT doc_id, 'standard_carveouts', CASE WHEN len(lacking) = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN len(lacking) = 0 THEN 'All 5 standard carveouts present: {", ".join(n for n, _ in assess.CARVEOUTS)}' ELSE 'Missing carveouts: ' || array_to_string(lacking, ', ') END FROM seen
  UNION ALL SELECT doc_id, 'term_duration', CASE WHEN term <> '' THEN 'pass' ELSE 'review' END, CASE WHEN term <> '' THEN 'Term duration found: ' || term ELSE 'No explicit term duration found — manual review recommended' END FROM seen
  UNION ALL SELECT doc_id, 'problematic_provisions', CASE WHEN len(wrong) = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN len(wrong) = 0 THEN 'No non-compete, non-solicitation, or exclusivity provisions found' ELSE 'Problematic provisions detected: ' || array_to_string(wrong, ', ') END FROM seen
  UNION ALL SELECT doc_id, 'governing_law', CASE WHEN law IS NOT NULL OR {_has(assess.LAW)} THEN 'pass' ELSE 'review' END, CASE WHEN law IS NOT NULL THEN 'Governing law clause found: ' || law WHEN {_has(assess.LAW)} THEN 'Governing law reference found in text' ELSE 'No governing law clause identified' END FROM seen)"""
_items = ", ".join(f"('{i}', '{n}', {str(c).lower()})" for i, n, _, c in assess.CHECKLIST)
ITEMS = f"""{CHECKS}, checklist AS (SELECT * FROM (VALUES {_items}) c(item_id, name, critical)),
items AS (SELECT d.doc_id, l.item_id, l.name, l.critical, coalesce(c.status, 'review') AS status, coalesce(c.finding, '') AS finding FROM corpus d CROSS JOIN checklist l LEFT JOIN checks c ON c.doc_id = d.doc_id AND c.item_id = l.item_id)"""
