"""Structural index and bracket nesting of documents with `{}[],:` outside strings.

The index is one row per live structural character. Brackets pair by depth: at one level of one
document opens and closes alternate until the first error, so a bracket's partner is its neighbour in the order
by level and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import char_class, comment_pattern, split_live, trim_ws
from tessera.sources.spec import Dialect

_MASK = "."


def masked(doc: Column, dialect: Dialect) -> Column:
    """doc with everything inside quotes, comments, and escaped pairs replaced by as many dots; positions stay."""
    text, quote, comment = doc, dialect.quote, dialect.comment
    if dialect.backslash and quote:
        e = dialect.escape_char
        text = F.replace(F.replace(text, F.lit(e * 2), F.lit(_MASK * 2)), F.lit(e + quote), F.lit(_MASK * 2))
    if comment:
        # parts in order: quoted, comment, other; what is met first makes the other inert
        q = char_class(quote) if quote else None
        inner = "".join(c for c in (quote, comment) if c)
        either = [rf"{q}[^{quote}]*+{q}?"] * bool(quote) + [comment_pattern(dialect), rf"[^\n{inner}]++", r"[\s\S]"]
        parts = F.regexp_extract_all(text, F.lit("(" + "|".join(either) + ")"), F.lit(1))
        dots = lambda x: F.repeat(F.lit(_MASK), F.length(x))
        begins = lambda x: F.startswith(x, F.lit(comment)) | (F.startswith(x, F.lit(quote)) if quote else F.lit(False))
        return F.array_join(F.transform(parts, lambda x: F.when(begins(x), dots(x)).otherwise(x)), "")
    if not quote:
        return text
    hidden = lambda s, i: F.when(i % 2 == 1, F.repeat(F.lit(_MASK), F.length(s))).otherwise(s)
    return F.array_join(F.transform(F.split(text, char_class(dialect.quote)), hidden), dialect.quote)


def structural_index(docs: DataFrame, doc: str, dialect: Dialect, key: str) -> DataFrame:
    """Rows (key, tape_idx, pos, byte): live structural characters in order; comment text has none."""
    chars = F.split(masked(F.col(doc), dialect), "")
    places = F.filter(F.transform(chars, lambda c, i: F.struct(i.cast("bigint").alias("pos"), c.alias("byte"))), lambda p: p["byte"].isin(*dialect.structural))
    return docs.select(key, F.posexplode(places).alias("tape_idx", "p")).select(key, "tape_idx", F.col("p.pos").alias("pos"), F.col("p.byte").alias("byte"))


def tape(docs: DataFrame, doc: str, dialect: Dialect, key: str, kinds: bool = True) -> DataFrame:
    """The index with level and partner (the partner's pos) of brackets; null for an unmatched one.

    bad marks a close without an open of its kind, or, without kinds, of any kind.
    """
    index = structural_index(docs, doc, dialect, key)
    opens, closes = [a for a, _ in dialect.nesting], [b for _, b in dialect.nesting]
    turn = F.when(F.col("byte").isin(*opens), 1).when(F.col("byte").isin(*closes), -1).otherwise(0)
    index = index.withColumn("turn", turn)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    index = index.withColumn("depth", F.sum("turn").over(upto))
    level = F.when(F.col("turn") == -1, F.col("depth") + 1).otherwise(F.col("depth"))
    index = index.withColumn("level", level)
    peers = Window.partitionBy(key, "level", F.col("turn") != 0).orderBy("pos")
    index = index.withColumn("_next", F.lead("pos").over(peers)).withColumn("_before", F.lag("pos").over(peers)).withColumn("_open", F.lag("byte").over(peers))
    right = F.lit(False)
    for a, b in dialect.nesting:
        right = right | ((F.col("byte") == b) & (F.col("_open") == a) if kinds else F.col("_open").isin(*opens))
    bad = (F.col("turn") == -1) & ~F.coalesce(right & (F.col("depth") >= 0), F.lit(False))
    index = index.withColumn("bad", bad)
    partner = F.when(F.col("turn") == 1, F.col("_next")).when((F.col("turn") == -1) & ~F.col("bad"), F.col("_before"))
    return index.select(key, "tape_idx", "pos", "byte", "level", partner.alias("partner"), "bad", "turn")


def errors(docs: DataFrame, doc: str, dialect: Dialect, key: str) -> DataFrame:
    """Rows (key, error, pos): UnmatchedClose at the first bad close, else UnclosedOpen at the innermost open at the end."""
    t = tape(docs, doc, dialect, key)
    found = t.groupBy(key).agg(F.min(F.when(F.col("bad"), F.col("pos"))).alias("_close"), F.max(F.when((F.col("turn") == 1) & F.col("partner").isNull(), F.col("pos"))).alias("_open"))
    error = F.when(F.col("_close").isNotNull(), "UnmatchedClose").when(F.col("_open").isNotNull(), "UnclosedOpen")
    found = found.select(key, error.alias("error"), F.coalesce("_close", "_open").alias("pos"))
    return docs.select(key).join(found, key, "left")


def scalars(doc: Column, dialect: Dialect) -> Column:
    """The trimmed non-empty texts between structural characters, in order; quotes stay, keys are among them."""
    parts = F.transform(split_live(doc, dialect, dialect.structural), trim_ws)
    return F.filter(parts, lambda x: x != "")


def integer_sum(docs: DataFrame, doc: str, dialect: Dialect) -> DataFrame:
    """(integers, sum) of all scalars that are integers."""
    found = docs.select(F.explode(scalars(F.col(doc), dialect)).alias("x")).filter(F.col("x").rlike(r"\A-?[0-9]+\z"))
    return found.agg(F.count("*").alias("integers"), F.coalesce(F.sum(F.col("x").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("bigint").alias("sum"))


def items(docs: DataFrame, doc: str, dialect: Dialect, key: str, level: int = 0) -> DataFrame:
    """Rows (key, place, item, container): one level's items in order, containers by their span, scalars trimmed.

    Level 0 is the document itself, of which there may be several on end.
    """
    t = tape(docs, doc, dialect, key).join(docs.select(key, F.col(doc).alias("_doc")), key)
    tops = t.filter((F.col("turn") == 1) & (F.col("level") == level + 1) & F.col("partner").isNotNull())
    boxed = tops.select(key, "pos", F.expr("substring(_doc, cast(pos + 1 as int), cast(partner - pos + 1 as int))").alias("item"), F.lit(True).alias("container"))
    edge = t.filter((F.col("turn") != 0) & (F.col("level") == level + 1) | (F.col("turn") == 0) & (F.col("level") == level))
    if level:
        edge = edge.unionByName(t.filter((F.col("turn") != 0) & (F.col("level") == level)))
    order = Window.partitionBy(key).orderBy("pos")
    gaps = edge.select(key, "pos", "turn", "level", "_doc", F.lead("pos").over(order).alias("to"), F.col("partner"))
    gap = F.expr("substring(_doc, cast(pos + 2 as int), cast(coalesce(to, length(_doc)) - pos - 1 as int))")
    # what follows an open of the next level lies inside it, what follows a close of this level lies outside
    inner = ~((F.col("turn") == 1) & (F.col("level") == level + 1)) & ~((F.col("turn") == -1) & (F.col("level") == level))
    plain = gaps.filter(inner).select(key, (F.col("pos") + 1).alias("pos"), trim_ws(gap).alias("item"), F.lit(False).alias("container"))
    if not level:
        first = t.groupBy(key).agg(F.min("pos").alias("p"))
        head = docs.select(key, F.col(doc).alias("_doc")).join(first, key, "left")
        head = head.select(key, F.lit(-1).cast("bigint").alias("pos"), trim_ws(F.expr("substring(_doc, 1, cast(coalesce(p, length(_doc)) as int))")).alias("item"), F.lit(False).alias("container"))
        plain = plain.unionByName(head)
    rows = boxed.unionByName(plain.filter("item <> ''"))
    return rows.withColumn("place", F.row_number().over(order) - 1).select(key, "place", "item", "container")
