"""Records of delimited text: from whole documents, from lines, and from files.

A record ends at a live newline. The last one may lack it; an empty remainder is no record, an empty line is one
with an empty field. Comment records (first character the comment byte, at a line's start outside quotes) are
left out, and quotes in them are inert. One carriage return at a record's end is trimmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.cells import live_quotes, split_fields, split_live, trim_cr, without_comments
from tessera.sources.spec import Dialect


def _without_remainder(parts: Column) -> Column:
    """parts without a final empty one, which is what follows the last terminator."""
    last = F.get(parts, F.size(parts) - 1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def document_records(doc: Column, dialect: Dialect) -> Column:
    """The records of a document as an array of raw strings, trimmed of their carriage return."""
    if not dialect.framed_by_lines:
        return F.when(doc == "", F.array().cast("array<string>")).otherwise(F.array(doc))
    if dialect.comment and dialect.quote:
        doc = without_comments(doc, dialect)
    parts = _without_remainder(split_live(doc, dialect, ("\n",)))
    if dialect.comment and not dialect.quote:
        parts = F.filter(parts, lambda r: ~F.startswith(r, F.lit(dialect.comment)))
    return F.transform(parts, trim_cr)


def terminated_count(doc: Column, dialect: Dialect) -> Column:
    """Records that end with a newline, comments included."""
    if dialect.comment and dialect.quote:
        rest = without_comments(doc, dialect)
        newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        # a comment that is left out takes its own newline with it
        return F.size(split_live(rest, dialect, ("\n",))) - 1 + newlines(doc) - newlines(rest)
    return F.size(split_live(doc, dialect, ("\n",))) - 1


def records(docs: DataFrame, doc: str, dialect: Dialect, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, rec_no, raw), one per record of each document of column `doc`."""
    return docs.select(*(keep or []), F.posexplode(document_records(F.col(doc), dialect)).alias("rec_no", "raw"))


def with_fields(rows: DataFrame, dialect: Dialect, raw: str = "raw", needed: int = -1) -> DataFrame:
    """rows with `fields`; of those after the first `needed` ones, if that is given, what is left may be one."""
    return rows.withColumn("fields", split_fields(F.col(raw), dialect, needed + 1 if needed >= 0 else -1))


def field_spans(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, field_no, start, length): where each of a row's raw fields lies in its record, in characters."""
    length = lambda x: F.length(x).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    after = lambda spans: F.get(spans, F.size(spans) - 1)
    start = lambda spans: F.when(F.size(spans) > 0, after(spans)["start"] + after(spans)["length"] + 1).otherwise(F.lit(0).cast("bigint"))
    spans = F.aggregate("fields", none, lambda found, x: F.concat(found, F.array(F.struct(start(found).alias("start"), length(x).alias("length")))))
    return rows.select(*(keep or []), F.posexplode(spans).alias("field_no", "s")).select(*(keep or []), "field_no", "s.start", "s.length")


def grouped_lines(docs: DataFrame, doc: str, dialect: Dialect, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, rec_no, fields): lines_per_record lines each; a last partial or unterminated group is dropped."""
    n = dialect.lines_per_record
    lines = F.split(doc, "\n")
    whole = F.floor((F.size(lines) - 1) / n).cast("int")
    cut = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.slice(lines, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
    out = docs.select(*(keep or []), F.posexplode(cut).alias("rec_no", "fields"))
    return out.withColumn("fields", F.transform("fields", trim_cr))


def file_lines(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """Rows (file, block, row, line) of text files, split into blocks by Spark's reader; no lines that begin with skip.

    block is where the split starts in its file; row numbers a block's lines without gaps.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    if skip:
        read = read.filter(~F.startswith("value", F.lit(skip)))
    meta = F.col("_metadata")
    return read.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")
    )


def file_records(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """Rows (file, rec_no, raw) of text files, whose records may span lines and blocks.

    Two passes, as quote parity is a prefix sum: every block's parity and lines are summed (one row per block),
    the blocks' prefixes come from a window over those few rows, and each block is then scanned by itself. So a huge
    file is not one task. Dialects without quotes need no pass over the parities and no assembly: every line is a
    record. Comments and quotes together take two readings of each block, see commented_file_records().
    """
    if dialect.comment and dialect.quote:
        return commented_file_records(file_lines(spark, path), dialect)
    if not dialect.quote:
        return _numbered_lines(file_lines(spark, path, dialect.comment))
    lines = file_lines(spark, path).withColumn("odd", live_quotes(F.col("line"), dialect) % 2)
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("parity"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = blocks.withColumn("entry", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).drop("parity")
    opened = (F.coalesce(F.sum("odd").over(inside), F.lit(0)) + F.col("entry")) % 2
    lines = lines.join(entry, ["file", "block"]).withColumn("starts", F.when(opened == 0, 1).otherwise(0))
    heads = lines.groupBy("file", "block").agg(F.sum("starts").alias("heads"))
    first = heads.withColumn("first", F.coalesce(F.sum("heads").over(before), F.lit(0))).drop("heads")
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(first, ["file", "block"]).withColumn("rec_no", F.col("first") + F.sum("starts").over(upto) - 1)
    parts = numbered.groupBy("file", "rec_no").agg(F.sort_array(F.collect_list(F.struct("block", "row", "line"))).alias("parts"))
    return parts.select("file", "rec_no", trim_cr(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("raw"))


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Rows (file, rec_no, raw) of lines that are records: a block's numbers follow from the counts of those before it."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # one row per block; Spark broadcasts it where it is small
    met = lines.join(first, ["file", "block"])
    return met.select("file", (F.col("first") + F.col("row") - F.col("least")).alias("rec_no"), trim_cr(F.col("line")).alias("raw"))


def _toggled(odd: np.ndarray, mark: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes, and whether what follows the last does.

    Every odd line toggles, but for comments outside quotes; only comments with an odd count are looked at one by one.
    """
    special = np.flatnonzero(odd & mark)
    state = np.logical_xor.accumulate(np.concatenate([[inside], np.where(mark, False, odd)]))
    for i in special.tolist():
        if state[i]:
            state[i + 1 :] ^= True
    return state[:-1], bool(state[-1])


def commented_file_records(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """file_records() where comments and quotes exclude each other, without a task that holds a file.

    What a line does depends on whether it begins inside quotes, so each block is read once for either state at its
    start, batch by batch: its lines get the state before them for both. A prefix over one row per block, the state that
    it ends in for either start, tells which of the two readings holds.
    """
    mark = F.startswith("line", F.lit(dialect.comment))
    lines = lines.select("file", "block", "row", F.col("line").cast("binary").alias("line"), mark.alias("mark"), (live_quotes(F.col("line"), dialect) % 2 == 1).alias("odd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's rows come from one task in order; a task may read several blocks
        now, state = None, [False, True]
        for batch in batches:
            block = batch.column(1).to_numpy()
            file = batch.column(0).dictionary_encode()
            code = file.indices.to_numpy()
            odd, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 4))
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(block)]
            before = np.zeros((2, len(block)), bool)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                here = (file[a].as_py(), int(block[a]))
                if here != now:
                    now, state = here, [False, True]
                for s in (0, 1):
                    before[s, a:b], state[s] = _toggled(odd[a:b], mark[a:b], state[s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[0]), pa.array(before[1])], [*batch.schema.names, "outer", "inner"])

    read = lines.mapInArrow(run, "file string, block bigint, row bigint, line binary, mark boolean, odd boolean, outer boolean, inner boolean")
    read = read.withColumn("line", F.col("line").cast("string"))
    after = lambda s: F.when(F.col("mark") & ~F.col(s), F.col(s)).otherwise(F.col(s) != F.col("odd"))
    ends = read.groupBy("file", "block").agg(F.max_by(after("outer"), "row").alias("from_out"), F.max_by(after("inner"), "row").alias("from_in"))
    # the states before the blocks: one row per file, of two bits for each block
    steps = F.sort_array(F.collect_list(F.struct("block", "from_out", "from_in")))
    state = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<block: bigint, open: boolean>>").alias("before"))

    def step(a, b):
        told = F.array_append(a["before"], F.struct(b["block"].alias("block"), a["open"].alias("open")))
        return F.struct(F.when(a["open"], b["from_in"]).otherwise(b["from_out"]).alias("open"), told.alias("before"))

    entry = ends.groupBy("file").agg(steps.alias("steps")).select("file", F.explode(F.aggregate("steps", state, step, lambda a: a["before"])).alias("e"))
    entry = entry.select("file", F.col("e.block").alias("block"), F.col("e.open").alias("entry"))
    known = read.join(entry, ["file", "block"]).withColumn("open", F.when(F.col("entry"), F.col("inner")).otherwise(F.col("outer")))
    known = known.filter(F.col("open") | ~F.col("mark"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = known.groupBy("file", "block").agg(F.count_if(~F.col("open")).alias("heads"))
    first = heads.withColumn("first", F.coalesce(F.sum("heads").over(before), F.lit(0))).drop("heads")
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = known.join(first, ["file", "block"]).withColumn("rec_no", F.col("first") + F.sum(F.when(F.col("open"), 0).otherwise(1)).over(upto) - 1)
    parts = numbered.groupBy("file", "rec_no").agg(F.sort_array(F.collect_list(F.struct("block", "row", "line"))).alias("parts"))
    return parts.select("file", "rec_no", trim_cr(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("raw"))
