"""Model replies as tables: lenient reading of JSON, natively; what that cannot read goes to a scan for whole objects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(replies: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Adds ``reply`` (null where it cannot be read): code fences off, outermost braces only, no commas before a closing bracket."""
    bare = F.regexp_replace(content, r"```(?:json)?", "")
    whole = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    clean = F.regexp_replace(whole, r",\s*([}\]])", "$1")
    return replies.withColumn("reply", F.when(clean != "", F.from_json(clean, schema)))


def unread(replies: DataFrame, content: str = "content") -> DataFrame:
    """The replies that ``parse`` cannot read as JSON: cut off, malformed or without any."""
    whole = F.regexp_extract(F.regexp_replace(content, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return replies.where(F.col(content).isNotNull() & F.try_parse_json(F.regexp_replace(whole, r",\s*([}\]])", "$1")).isNull())


#: Lists that are looked for in a reply that was cut off, in this order, and single values before them.
LISTS = ["discovered_facts", "obligations", "key_risks", "recommendations", "missing_protections", "escalation_items"]
SINGLES = ["summary", "categories_found", "executive_summary", "overall_risk_rating", "total_affirmative", "total_negative", "total_conditional"]
_MARK = re.compile(r'\\.|["{}\]]', re.S)


def _objects(text: str, at: int) -> Iterator[str]:
    """The whole objects of a list that begins at ``at``, as JSON text. Only quotes, braces, closing brackets and escapes
    are stopped at: a quote opens or ends a string, inside which nothing else counts."""
    quoted, depth, begin = False, 0, 0
    for found in _MARK.finditer(text, at):
        mark = found.group()
        if mark == '"':
            quoted = not quoted
        elif quoted or len(mark) > 1:
            continue
        elif mark == "]":
            if not depth:
                return
        elif mark == "{":
            begin, depth = begin if depth else found.start(), depth + 1
        else:
            depth -= 1
            if not depth:
                for body in (text[begin : found.end()], re.sub(r",\s*([}\]])", r"\1", text[begin : found.end()])):
                    try:
                        yield json.dumps(json.loads(body), ensure_ascii=False)
                        break
                    except ValueError:
                        continue


def salvage_lists(replies: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, list, n, object, singles) of the replies that cannot be read: every whole object of the first of ``LISTS`` that has
    any, and the single values (as text) that stand before it. Replies without such a list give no row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[content]):
                text = text[text.find("{") :] if "{" in text else ""
                for name in LISTS:
                    head = re.search(rf'"{name}"\s*:\s*\[', text)
                    objects = list(_objects(text, head.end())) if head else []
                    if objects:
                        before = [(s, re.search(rf'"{s}"\s*:\s*(?:"([^"]*)"|(\d+))', text[: head.start()])) for s in SINGLES]
                        singles = {s: m.group(1) if m.group(1) is not None else m.group(2) for s, m in before if m}
                        rows += [(k, name, n, o, singles) for n, o in enumerate(objects)]
                        break
            yield pd.DataFrame(rows, columns=[key, "list", "n", "object", "singles"])

    kind = dict(replies.dtypes)[key]
    return unread(replies, content).select(key, content).mapInPandas(scan, f"{key} {kind}, list string, n long, object string, singles map<string,string>")


def salvage(replies: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(key, n, object): every whole innermost-list object of a reply cut off in its middle, as JSON text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = json.JSONDecoder()
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[content]):
                at, n = (text or "").find("["), 0
                while at >= 0 and (at := text.find("{", at)) >= 0:
                    try:
                        found, at = reader.raw_decode(text, at)
                    except ValueError:
                        break
                    rows.append((k, n, json.dumps(found, ensure_ascii=False)))
                    n += 1
            yield pd.DataFrame(rows, columns=[key, "n", "object"])

    kind = dict(replies.dtypes)[key]
    return replies.select(key, content).mapInPandas(scan, f"{key} {kind}, n long, object string")
