"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Which hashes are kept
does not depend on the document, so sketches merge by union and compare also where one document is
far longer than the other: likeness() estimates the Jaccard similarity, containment() the share of one
document's shingles that another holds.

Shingles are SHINGLE words in order; a text with fewer words is one shingle. A text whose hashes all
lie above the threshold keeps its least one, so only a text without words has an empty sketch. That one is no
sample: it compares with others of its kind only. How much a longer text holds of such a text is undefined, so
containment() is null there, their likeness() is 0, and merge() drops the hash beside hashes below the threshold.

Nulls: a null text is empty. Two empty sketches are alike (1), an empty one and another are not (0). A
null doc_id precedes the others. Where rows share a doc_id, the next document's text is the
least of those that have the next doc_id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, ranked, table

SHINGLE = 5
#: One of so many hashes is kept.
SCALE = 4
_WHITE = r"[\x20\x09-\x0D]+"
#: Hashes are 63 bits, not negative.
_BITS = 63


def split_words(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _WHITE)))


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles of an array of words."""

    def hashes(ws):
        starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (width - 1), F.lit(1)))
        # get() is null past the end, which the hash skips: a short text is one shingle
        rest = lambda i: [F.get(ws, i + k) for k in range(1, width)]
        return F.transform(starts, lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *rest(i)), 64 - _BITS))

    return let(words, hashes)


def sketch(text: Column, width: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted sketch of a text, an array of longs."""
    below = F.lit((1 << _BITS) // scale)

    def kept(hs):
        low = F.filter(hs, lambda h: h < below)
        least = F.when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(hs)
        return let(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(least))

    return let(shingle_hashes(split_words(text), width), kept)


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    both = _overlap(a, b)
    ratio = let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio)


def _low(a: Column, scale: int) -> Column:
    return F.filter(a, lambda h: h < F.lit((1 << _BITS) // scale))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The share of a's shingles that b has; null where a has no sample of them and b does."""
    unknown = (F.size(_low(a, scale)) == 0) & (F.size(_low(b, scale)) > 0)
    return F.when(F.size(a) == 0, 1.0).when(unknown, F.lit(None).cast("double")).otherwise(_overlap(a, b) / F.size(a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of what both hold."""
    both = F.array_sort(F.array_union(a, b))
    return let(both, lambda x: F.when(F.size(_low(x, scale)) > 0, _low(x, scale)).otherwise(F.slice(x, 1, 1)))


def to_text(sketched: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, extras: dict[str, Column] | None = None) -> DataFrame:
    """Rows (doc_id, text, _quarter, _opening, *extras): the next document's opening of _quarter code points.

    The next document is that of the next doc_id, after the last the first. extras are computed from the
    next document's text. Ids alone are ordered; texts are dealt once by doc_id, and of each
    document only its opening and the extras travel to the one before it.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint"))
    plain = docs.select("doc_id", key.alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = ranked(plain.groupBy("_id").agg(F.max(quarter).alias("_quarter")), [F.col("_id")], "_rank")
    n = ids.count()
    before = ids.select(F.pmod(F.col("_rank") + 1, F.lit(max(n, 1))).alias("_rank"), F.col("_id").alias("_to"), F.col("_quarter").alias("_need"))
    route = ids.join(before, "_rank").select("_id", "_to", "_need")
    here = plain.join(route, "_id")
    # by doc_id too, so that both uses of `here` read the same columns and share one exchange
    first = Window.partitionBy("_id").orderBy("text", "doc_id")
    sent = here.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    sent = sent.select(F.col("_to").alias("_id"), F.substring("text", F.lit(1), F.col("_need")).alias("_opening"), *[c.alias(k) for k, c in (extras or {}).items()])
    out = here.select("_id", "doc_id", "text", quarter.alias("_quarter")).join(sent, "_id")
    return out.withColumn("_opening", F.substring("_opening", F.lit(1), F.col("_quarter"))).drop("_id")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; contained_* is the share of its shingles that the other text has, null where that is unknown."""
    pairs = with_next(table(spark, sf_dir, "documents"), {"_next": sketch(F.col("text"))})
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("_quarter"))
    out = pairs.select("doc_id", "text", "_next", F.concat(kept, F.col("_opening")).alias("_edited"))
    out = out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("_own"),
        sketch(F.col("_edited")).alias("_changed"),
        "_next",
    )
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.col("_own")).alias("fingerprint"),
        to_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
        containment(F.col("_own"), F.col("_changed")).alias("contained_in_edited"),
        containment(F.col("_own"), F.col("_next")).alias("contained_in_next"),
    )
