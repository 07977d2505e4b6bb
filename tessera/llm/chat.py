"""Chat formatting with typed content parts.

A turn's content is an array of parts {type, text, ref, tokens}. A visitor, one CASE per part type, flattens
it into one string: texts are escaped, an image, audio or document part becomes an ordered placeholder. Every
attachment is recorded as {turn, type, ref, index, tokens}, in order, with the tokens that its placeholder
expands to. format_conversations() marks the turns and joins them by conversation; read_back() parses its
output alone.

Template: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> for each turn. Inside roles and texts a backslash is
doubled, and one is put after the first character of every control string (CONTROL), so none is left; dropping
each backslash and keeping what follows restores the text.

Nulls: a null text is empty, a null role is empty, null content has no parts, a null conv_id is a
conversation. Turns that tie are ordered by role, then text, so rows that repeat become turns of their own.
Unknown part types are texts. A conversation is one output row, so it is held by one task, as the
format demands; all else is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Where a control string of this template or of other common ones begins: its first character, then the rest.
CONTROL = r"(?i)([<\[])(?=\||/?s>|/?INST\]|</?SYS>|/?(?:unk|pad|bos|eos)>|(?:start|end)_of_turn>)"
PART = "array<struct<type: string, text: string, ref: string, tokens: bigint>>"
#: Tokens of an attachment that states none.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
#: Role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The content of a turn that is one text."""
    nothing = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), nothing.cast("string").alias("ref"), nothing.cast("bigint").alias("tokens"))
    return F.array(part)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*EXPANDED), F.lit(False))


def _tokens(part: Column) -> Column:
    usual = F.lit(0)
    for kind, n in EXPANDED.items():
        usual = F.when(part["type"] == kind, n).otherwise(usual)
    return F.coalesce(part["tokens"], usual.cast("bigint"))


def flatten(parts: Column) -> Column:
    """The string that a turn's parts become; placeholders are numbered within the turn."""
    held = F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p.isNotNull())

    def visit(part, i):
        before = F.size(F.filter(F.slice(held, F.lit(1), i), _is_attachment))
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), before.cast("string"), F.lit("|>"))
        return F.when(_is_attachment(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(held, visit), "")


def attachments(turn: Column, parts: Column) -> Column:
    held = F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p.isNotNull() & _is_attachment(p))
    return F.transform(
        held,
        lambda p, i: F.struct(turn.cast("bigint").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), i.alias("index"), _tokens(p).alias("tokens")),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, spans, attachments, expanded_tokens) from rows (conv_id, turn, role, parts).

    spans has one {start, length, loss} for each turn: where its text lies in formatted, in code points from 0,
    and whether it is trained on.
    """
    body = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), flatten(F.col("parts")).alias("_text"), attachments(F.col("turn"), F.col("parts")).alias("_attached"))
    head = F.concat(F.lit(START), escape(F.col("_role")), F.lit(SEP))
    body = body.withColumn("_head", head).withColumn("_length", F.length("_head") + F.length("_text") + len(END))
    order = ["turn", "_role", "_text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumn("_start", F.coalesce(F.sum("_length").over(before), F.lit(0)) + F.length("_head"))
    # sorted by where they start, which is the turns' order
    one = F.struct(F.col("_start"), F.col("_head"), F.col("_text"), (F.col("_role") == LOSS_ROLE).alias("_loss"), F.col("_attached"))
    whole = body.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    span = lambda t: F.struct(t["_start"].alias("start"), F.length(t["_text"]).cast("bigint").alias("length"), t["_loss"].alias("loss"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: F.concat(t["_head"], t["_text"], F.lit(END))), "").alias("formatted"),
        F.transform("_turns", span).alias("spans"),
        F.flatten(F.transform("_turns", lambda t: t["_attached"])).alias("attachments"),
    )
    return whole.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of {role, text, loss} parsed from formatted and spans, unescaped.

    A turn is under the loss mask where its parsed text fills a span that says so, in length and offset: a span has
    to start where the one before it ends and this turn's head is over. So a wrong offset anywhere takes the rest out of
    the mask, and the work grows with the conversation's length only.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>")))
    raw = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, SEP, 1).alias("role"),
            F.regexp_replace(F.regexp_replace(p, r"(?s)\A.*?<\|im_sep\|>", ""), r"<\|im_end\|>\z", "").alias("text"),
        ),
    )
    plain = F.lit(len(START) + len(SEP))

    def turn(p, i):
        s, before = F.get("spans", i), F.get("spans", i - 1)
        head = plain + F.length(p["role"])
        start = F.when(i == 0, head).otherwise(before["start"] + before["length"] + len(END) + head)
        fills = (F.length(p["text"]) == s["length"]) & (start == s["start"])
        return F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text"), F.coalesce(s["loss"] & fills, F.lit(False)).alias("loss"))

    return formatted.withColumn("turns", F.transform(raw, turn))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted, then digested from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    turns = rows.unionByName(extra).withColumn("parts", text_parts(F.col("text")))
    back = read_back(format_conversations(turns))
    newline = F.lit("\n")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests from the rows, without the format; the template's marks and escapes are counted.
OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text)
    + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(role || chr(10) || text, '(?i)[<\[](?:\||/?s>|/?INST\]|</?SYS>|/?(?:unk|pad|bos|eos)>|(?:start|end)_of_turn>)')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + count(*) * 32 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
