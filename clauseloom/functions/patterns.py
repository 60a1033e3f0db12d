"""Contract patterns as column expressions: normalised text in, arrays of spans out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that become straight quotes and hyphens, one for one, so that offsets stay.
QUOTES_FROM, QUOTES_TO = "“”„‘’‚–—«»", "\"\"\"'''--\"\""

#: The patterns, in the order in which equal starts are ranked. Flags: i case, U and d as Python's text rules.
DEFINITION = r'(?iUdm)"([^"]+)"\s+(?:shall\s+mean|means|refers?\s+to|is\s+defined\s+as|designates?|constitutes?|includes?)\s+(.+?)(?:\.|$)'
PARENTHETICAL = r"(?Ud)\((?:the\s+)?[\"']([A-Za-z][A-Za-z\s\-]+?)[\"'](?:\s+or\s+[\"']([A-Za-z][A-Za-z\s\-]+?)[\"'])?\)"
SECTION = r"(?iUd)(?:§|Section|Clause|Article|Appendix|Schedule|Annex)\s*(\d+(?:\.\d+)*(?:\s*\([a-z]\))?|[A-Z])"
DURATION = r"(?iUd)(?:(\w+)\s+\()?(\d+)\)?\s*(days?|months?|years?|weeks?|business\s+days?)"
MONETARY = r"(?iUd)(?:[$€£¥]|USD|EUR|GBP|INR)\s*[\d,]+(?:\.\d{1,2})?|[\d,]+(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|INR|dollars?|pounds?|euros?)"
DATE = r"(?iUd)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"
PERCENTAGE = r"(?Ud)\d+(?:\.\d+)?\s*%"
#: An alias match can only begin at the head of a run of letters; beginning anywhere in the run gives the same groups in square time.
RUN = r"(?<![A-Za-z\s&.,])[\s&.,]*+"
ALIAS = rf"(?iUd){RUN}([A-Z][A-Za-z\s&.,]+?)\s*,?\s*(?:hereinafter\s+(?:referred\s+to\s+as|called)|hereafter\s+(?:referred\s+to\s+as|called|)|\(the\s+|\()\s*[\"']([A-Za-z\s]+?)[\"']"
PARTY = rf"(?iUd){RUN}([A-Z][A-Za-z\s&.,]+?(?:Corp(?:oration)?|Inc\.?|LLC|Ltd\.?|Pvt\.?\s*Ltd\.?|L\.?P\.?|Company|Co\.))[,\s]+(?:a\s+)?[A-Za-z\s]+?(?:corporation|company|partnership|entity|limited\s+liability|limited)\s*[,(]\s*[\"']?([A-Za-z\s]+?)[\"']?\s*\)"

#: (pattern name, rank, regex, group whose text is the value)
PATTERNS = [
    ("definition", 0, DEFINITION, 1),
    ("definition", 1, PARENTHETICAL, 1),
    ("section_reference", 2, SECTION, 0),
    ("duration", 3, DURATION, 0),
    ("monetary", 4, MONETARY, 0),
    ("date", 5, DATE, 0),
    ("percentage", 6, PERCENTAGE, 0),
    ("entity_alias", 7, ALIAS, 0),
    ("entity_alias", 8, PARTY, 0),
]
#: What the patterns are searched by: the same matches, with guards that turn a place away early. A case-blind s is also the
#: long one, an i the dotted capital and the dotless one. A word before a bracket is read from its head or where the last match ended. A
#: run of letters that no bracket or quote follows holds no alias.
_RUN_ENDS = r"(?=[A-Za-z\s&.,]++[(\"'%s])"
FAST = {
    SECTION: SECTION.replace("(?iUd)", r"(?iUd)(?=[§scaſ])", 1),
    DURATION: DURATION.replace(r"(?:(\w+)\s+\()?", r"(?:(?:(?<!\w)|\G)(\w++)\s++\()?", 1),
    MONETARY: MONETARY.replace("(?iUd)", r"(?iUd)(?=[$€£¥\d,uegiİı])(?:", 1) + ")",
    DATE: DATE.replace("(?iUd)", r"(?iUd)(?=[\djfmasondſ])(?:", 1) + ")",
    PERCENTAGE: PERCENTAGE.replace("(?Ud)", r"(?Ud)(?=\d)", 1),
    ALIAS: ALIAS.replace(RUN, RUN + _RUN_ENDS % "", 1),
    PARTY: PARTY.replace(RUN, RUN + _RUN_ENDS % ")", 1),
}
#: White space by Unicode's property, for Python's ``re``, whose own holds four control characters more.
_WHITE = " \\t\\n\\v\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def in_python(regex: str) -> str:
    """A regex of Unicode classes, without its flags, as Python reads it."""
    body, inside, out = re.sub(r"^\(\?\w+\)", "", regex), False, ""
    for part in re.split(r"(\\.|\[|\])", body):
        inside = part == "[" or inside and part != "]"
        out += part if part != r"\s" else _WHITE if inside else f"[{_WHITE}]"
    return out


SPAN = "struct<start:int,rank:int,n:int,stop:int,pattern:string,value:string,a:string,b:string>"


def normalize_quotes(text: Column) -> Column:
    """Lengths tell texts of ASCII alone, which hold none of the quotes, without a look at each character."""
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(f"[{QUOTES_FROM}]"), F.translate(text, QUOTES_FROM, QUOTES_TO)).otherwise(text)


#: Two noncharacters that mark where a match begins and ends; a text that holds one itself shows U+FFFD in its place.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def find_spans(text: Column, regex: str, groups: tuple[int, ...] = ()) -> Column:
    """Every match with its offsets: array of (start, stop, match, g1, ...), the groups asked for after the match.

    One scan marks the matches; what stands between the marks has the lengths whose running sums are the offsets. Groups
    are read from the match alone.
    """
    by = FAST.get(regex, regex)
    marked_before = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    plain = F.when(marked_before, F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd")).otherwise(text)
    marked = F.regexp_replace(plain, by, f"{_OPEN}$0{_CLOSE}")

    def spans(parts):
        """The first part ends where the first match begins; every later one is a match, its mark and the gap after it."""
        starts = F.aggregate(parts, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)) - 1, F.lit(0)) + F.length(x)))
        found = F.zip_with(parts, F.concat(F.array(F.lit(0)), starts), lambda x, at: _let(F.substring_index(x, _CLOSE, 1), lambda m: F.struct(at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("match"), *[F.regexp_extract(m, by, g).alias(f"g{g}") for g in groups])))
        return F.slice(found, 2, F.size(parts) - 1)

    return _let(F.split(marked, _OPEN, -1), spans)


#: Groups that a pattern's spans carry as a and b, and text without which it cannot match.
_GROUPS = {DEFINITION: (1, 2), PARENTHETICAL: (1, 2), SECTION: (1,), DURATION: (2, 3), ALIAS: (1, 2), PARTY: (1, 2)}
_NEEDS = {DEFINITION: '"', PARENTHETICAL: "(", PERCENTAGE: "%", PARTY: ")"}


def _spans_of(text: Column, name: str, rank: int, regex: str, group: int) -> Column:
    groups = _GROUPS.get(regex, ())
    run, none = regex in (ALIAS, PARTY), F.lit(None).cast("string")

    def span(m, i):
        lead = F.length(F.regexp_extract(m["match"], r"^[\s&.,]*", 0)) if run else F.lit(0)
        value = F.substring(m["match"], lead + 1, F.length(m["match"])) if run else m["match"] if group == 0 else m[f"g{group}"]
        parts = [F.trim(m[f"g{g}"]) if run or regex == PARENTHETICAL or g == 2 and regex == DEFINITION else m[f"g{g}"] for g in groups] + [none, none]
        made = lambda n, v, a, b: F.struct((m["start"] + lead).alias("start"), F.lit(rank).alias("rank"), n.alias("n"), m["stop"].alias("stop"), F.lit(name).alias("pattern"), v.alias("value"), a.alias("a"), b.alias("b"))
        if regex != PARENTHETICAL:
            return made(i, value, parts[0], parts[1])
        # the second term of (the "A" or "B") has the same span
        one, two = made(i * 2, parts[0], parts[0], none), made(i * 2 + 1, parts[1], parts[1], none)
        return F.when(parts[1] != "", F.array(one, two)).otherwise(F.array(one))

    spans = F.transform(find_spans(text, regex, groups), span)
    spans = (F.flatten(spans) if regex == PARENTHETICAL else spans).cast(f"array<{SPAN}>")
    return F.when(F.contains(text, F.lit(_NEEDS[regex])), spans).otherwise(F.array().cast(f"array<{SPAN}>")) if regex in _NEEDS else spans


def spans_in(normal: Column, ranks: tuple[int, ...] = tuple(range(len(PATTERNS)))) -> Column:
    """The spans of some patterns in a text with straight quotes, by start, then pattern, then order of finding; overlaps still
    there. ``normal`` is written out at each use, so it should be a column."""
    return F.array_sort(F.concat(*[F.coalesce(_spans_of(normal, *PATTERNS[r]), F.array()).cast(f"array<{SPAN}>") for r in ranks]))


def all_spans(text: Column) -> Column:
    """All patterns' spans in a text of any quotes."""
    return F.get(F.transform(F.array(normalize_quotes(text)), lambda normal: spans_in(normal)), F.lit(0))


def drop_overlaps(spans: Column) -> Column:
    """Fold over sorted spans: one that overlaps the last kept span, of the same pattern, is dropped unless it is longer; then it replaces it."""

    def step(kept, s):
        last = F.element_at(kept, -1)
        clash = (F.size(kept) > 0) & (s["start"] < last["stop"]) & (s["pattern"] == last["pattern"])
        longer = s["stop"] - s["start"] > last["stop"] - last["start"]
        return F.when(clash & longer, F.array_append(F.slice(kept, 1, F.size(kept) - 1), s)).when(clash, kept).otherwise(F.array_append(kept, s))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def extract_patterns(text: Column) -> Column:
    return drop_overlaps(all_spans(text))
