"""Chat formatting with typed content parts; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One content part. ``text`` is used by text parts, the others by attachments of type image, audio or document.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment stands for: 14-pixel patches merged two by two, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 12.5, 256
#: Turns gathered in the first of the two grouping steps.
CHUNK = 32


def escape(x: Column) -> Column:
    """Backslash before every character that can begin a control string; undone by :func:`unescape`."""
    for c in ("\\", "#", "<", ":"):
        x = F.replace(x, F.lit(c), F.lit("\\" + c))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _inside(x: Column) -> Column:
    """``x`` within the marks of an attachment, where a space and ``>`` are escaped too."""
    x = escape(F.coalesce(x, F.lit("")))
    for c in (" ", ">"):
        x = F.replace(x, F.lit(c), F.lit("\\" + c))
    return x


def _visit(part: Column) -> Column:
    """The text that stands for one part: text escaped, an attachment as ``<type ref>``, which no escaped text can hold."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", text).otherwise(F.concat(F.lit("<"), _inside(part["type"]), F.lit(" "), _inside(part["ref"]), F.lit(">")))


def _tokens(part: Column) -> Column:
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE)
        .otherwise(0)
        .cast("long")
    )


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part; null counts as empty."""
    value = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(value)


def format_chats(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    A turn reads ``### role: body </turn>`` and a newline. ``loss_spans`` marks the bodies of assistant turns as
    (segment, start, length) in code points, a segment being what one turn yields. ``attachments`` lists (segment, part,
    type, ref, n_tokens) in order. Rows go by turn, then role, then body (nulls first); null role: empty; null or empty
    parts: empty body; a null conversation is one of its own. Other columns are ignored; no rows give no rows. Turns are
    joined in two steps, so a long conversation is gathered as a few chunks; its one string is what the caller asked for.
    """
    parts = F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    seen = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("n_tokens")))
    head = F.concat(F.lit("### "), escape(F.col("role")), F.lit(": "))
    rows = (
        turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.array_join(F.transform(parts, _visit), "").alias("body"), F.filter(seen, lambda s: F.coalesce(s["type"], F.lit("text")) != "text").alias("seen"))
        .withColumn("chunk", F.floor(F.col("turn") / CHUNK))
        .withColumn("start", F.length(head))
        .withColumn("one", F.struct("turn", "role", "body", "start", "seen", F.concat(head, "body", F.lit(" </turn>\n")).alias("segment")))
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("one")).alias("many"))
    whole = chunks.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "many"))), lambda c: c["many"])).alias("all"))
    numbered = F.transform("all", lambda t, i: F.struct(i.alias("segment"), t["start"].alias("start"), F.length(t["body"]).alias("length"), t["role"].alias("role"), t["seen"].alias("seen")))
    spans = F.transform(F.filter(numbered, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["segment"], t["start"], t["length"]))
    listed = F.flatten(F.transform(numbered, lambda t: F.transform(t["seen"], lambda s: F.struct(t["segment"].alias("segment"), s["part"], s["type"], s["ref"], s["n_tokens"]))))
    out = whole.select("conv_id", F.array_join(F.transform("all", lambda t: t["segment"]), "").alias("formatted"), spans.alias("loss_spans"), listed.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, still escaped, without their end marks."""
    return F.slice(F.split(formatted, " </turn>\n", -1), F.lit(1), F.size(F.split(formatted, " </turn>\n", -1)) - 1)


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read conversations back: adds ``turns`` (role, text) and ``loss_text``, the unescaped text under the loss mask."""
    turn = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"
    parsed = F.transform("_parts", lambda x: F.struct(unescape(F.regexp_extract(x, turn, 1)).alias("role"), unescape(F.regexp_extract(x, turn, 2)).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.element_at("_parts", s["segment"].cast("int") + 1), s["start"] + 1, s["length"])))
    return chats.withColumn("_parts", segments(F.col("formatted"))).withColumn("turns", parsed).withColumn("loss_text", F.array_join(under, "")).drop("_parts")


def read_parts(chats: DataFrame) -> DataFrame:
    """Adds ``parts`` to formatted conversations: for each turn its parts in order, as (type, text, ref) read back from the text.

    Text parts have no ref and attachments no text. Neighbouring text parts come back as one, empty ones not at all.
    """
    body = lambda x: F.regexp_extract(x, r"(?s)^### (?:[^:\\]++|\\.)*+: (.*)$", 1)
    # with a pair of backslashes written as \b, every < or > after a backslash is an escaped one
    shown = lambda x: F.replace(body(x), F.lit("\\\\"), F.lit("\\b"))
    back = lambda x: unescape(F.replace(x, F.lit("\\b"), F.lit("\\\\")))
    none, mark = F.lit(None).cast("string"), r"(?s)^(.*?)(?<!\\) (.*?)(?<!\\)>(.*)$"
    part = lambda type, text, ref: F.struct(type.alias("type"), text.alias("text"), ref.alias("ref"))
    words = lambda x: F.array(part(F.lit("text"), back(x), none))
    attached = lambda x: F.array(part(back(F.regexp_extract(x, mark, 1)), none, back(F.regexp_extract(x, mark, 2))))
    piece = lambda x, i: F.when(i == 0, words(x)).otherwise(F.concat(attached(x), words(F.regexp_extract(x, mark, 3))))
    parts = F.transform(segments(F.col("formatted")), lambda x: F.filter(F.flatten(F.transform(F.split(shown(x), r"(?<!\\)<", -1), piece)), lambda p: F.coalesce(p["text"], F.lit("-")) != ""))
    return chats.withColumn("parts", parts)


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = rows.unionByName(probe)
    read = parse_chats(format_chats(rows, text_parts(F.col("text"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS head FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
