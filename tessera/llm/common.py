"""Helpers that several operators share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup table up to which it may be broadcast; counted before every use.
BROADCAST_ROWS = 20_000
#: Copies of a larger lookup table's rows, against keys that hold much of the other side.
SALTS = 16
#: A key with more than this share of all rows, and at least so many, is joined apart; at most 1 / HOT_SHARE have it.
HOT_SHARE, HOT_ROWS = 1 / 1000, 200
#: Bits of a mask that says which rows are worth a join, and the bytes of a bitmap of which it is made.
MASK_BITS, _BITMAP = 1 << 24, 4096
#: Rows of a batch that is sent to Python at most; operators work on a megabyte of text at once, so more only take memory on both sides.
ARROW_ROWS, _ARROW_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of monotonically_increasing_id() that number the rows of one partition.
_ROW_BITS = 33


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the checkpoint folder, with its lineage cut.

    The folder is the session's spark.checkpoint.dir; a local one is set only where none is, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ARROW_ROWS; no result depends on them."""
    if not 0 < int(spark.conf.get(_ARROW_KEY)) <= ARROW_ROWS:
        spark.conf.set(_ARROW_KEY, ARROW_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def join_lookup(df: DataFrame, lookup: DataFrame, on: str, rows: int | None = None) -> DataFrame:
    """df left-joined with a table of one row per value of `on`, whatever share of df one value holds.

    A table of at most BROADCAST_ROWS rows is broadcast; a larger one is copied SALTS times and joined on
    the value and a salt, which splits a hot value's rows over as many tasks.
    """
    rows = lookup.count() if rows is None else rows
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(lookup), on, "left")
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != on]), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", spread).join(salted, [on, "_salt"], "left").drop("_salt")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its gapless 0-based position in the order, without a one-task window.

    Rows are dealt into ranges, sorted and numbered inside each range; the ranges' offsets are a table of
    one row per partition. The numbered rows are checkpointed, so that later reads agree on the numbers.
    Ties in `order` are numbered in any way; callers pass a total order.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition of `dealt`, at most a few thousand
    at, before = 0, []
    for r in sorted(counts.collect()):
        before.append((r["_part"], at))
        at += r["_n"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, row + F.col("_before")).drop("_at", "_part", "_before")


def hot_keys(counts: DataFrame, key: str, rows: str) -> list:
    """Values of key with at least HOT_SHARE of all rows, of a table of one row per value; 1 / HOT_SHARE at most."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    found = [r[0] for r in counts.filter(F.col(rows) >= least).select(key).distinct().collect()]
    return [bytes(x) if isinstance(x, bytearray) else x for x in found]


def join_spread(df: DataFrame, lookup: DataFrame, on: str | list[str], hot: list, how: str = "inner") -> DataFrame:
    """df joined with a table of one row per value of `on`; rows of hot values of the first column stay where they are.

    hot is what hot_keys() gives, so its rows of the table are few and are broadcast.
    """
    on = [on] if isinstance(on, str) else on
    if not hot:
        return df.join(lookup, on, how)
    is_hot = F.coalesce(F.col(on[0]).isin(hot), F.lit(False))
    few = df.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), on, how)
    return few.unionByName(df.filter(~is_hot).join(lookup.filter(~is_hot), on, how))


def mask_place(*cols: str | Column) -> Column:
    """Which of MASK_BITS bits stands for these values."""
    return F.pmod(F.xxhash64(*cols), F.lit(MASK_BITS))


def _bitmaps(df: DataFrame, *cols: str) -> DataFrame:
    """Rows (bucket, bits) of at most MASK_BITS bits in all: the places of the rows of df."""
    place = mask_place(*cols) + 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(place))
    return df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(bits.alias("bits"))


def bit_mask(df: DataFrame, *cols: str) -> np.ndarray:
    """The places of the rows of df as packed bits, the lowest first; MASK_BITS / 8 bytes at any number of rows."""
    out = np.zeros(MASK_BITS // 8, np.uint8)
    for r in _bitmaps(df, *cols).collect():
        at = (r["bucket"] - 1) * _BITMAP
        out[at : at + _BITMAP] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, by verdicts (doc_id, text_hash, kept), one for each row.

    Of rows that repeat a doc_id and a text and may stay, the one with the least hash does. Rows whose bit in a mask of
    what is dropped or repeated is not set stay without a join, so the texts that stay are not dealt out.
    """
    pairs = verdicts.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("_stays"), F.min("kept").alias("_all"), F.count("*").alias("_n"))
    dropped = checkpointed(pairs.filter("not _all or _n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_stays"))
    bitmaps = F.broadcast(checkpointed(_bitmaps(dropped, "_id", "_hash")))
    order = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    # the row travels as one column, so its names can't clash
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"), order.alias("_order"))
    place = mask_place("_doc_id", "_text_hash") + 1
    met = marked.join(bitmaps, F.bitmap_bucket_number(place) == F.col("bucket"), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marks = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    judged = met.filter(marks).drop("bucket", "bits").join(dropped, same, "left")
    sure = met.filter(~marks).select("_row").unionByName(judged.filter("_stays is null").select("_row"))
    again = judged.filter("_stays").groupBy("_doc_id", "_text_hash").agg(F.min_by("_row", "_order").alias("_row"))
    return sure.unionByName(again.select("_row")).select("_row.*")


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    while name in df.columns:
        name += "_"
    return name
