"""Records of chunked streams, with state per stream.

A source delivers rows (stream, seq, chunk, eof). A record may span chunks, and quotes and escapes too, so
the state of a stream is the text that no record has taken yet; the next chunk is scanned after it. A row with
eof flushes the last record, which may lack its terminator. Groups of lines are cut in the same way. Chunks of one micro-batch may come in any order
and are sorted by seq. The records equal those of the joined chunks read at once.

Chunks that lie next to each other in a batch and follow each other in their stream are joined before they are shuffled, so what
is dealt out, sorted and handed to the state's Python is about a row for each stream where a feed brings streams one after the other.
Any (stream, seq) comes once.

A call of Python and a row of the state store serve a bucket of streams, dealt by a hash, as they cost a thousand times
what a short stream does. A bucket's chunks of one micro-batch and its open streams' rests are held at once, so their
number should grow with the input; it must stay the same as long as a checkpoint is used.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.spec import Dialect

#: Of a bucket: its open streams as JSON, each (stream, rest, records so far).
STATE = "open string"
#: Buckets of streams where the caller knows no better, and the chunks for which a replay makes a bucket.
BUCKETS, BUCKET_CHUNKS = 1024, 20_000
#: Records of a bucket that leave Python as one row at most, and about so many characters.
PACKED, PACKED_CHARS = 20, 1000


@lru_cache
def _stops(dialect: Dialect) -> tuple[re.Pattern, re.Pattern]:
    """What a scan stops at outside quotes, and within them; an escape takes the next character along, but no newline."""
    escaped = [re.escape(dialect.escape_char) + r"(?:[^\n]|(?=\n)|\Z)"] if dialect.backslash else []
    quote = [re.escape(dialect.quote)] if dialect.quote else []
    return re.compile("|".join([*escaped, *quote, r"\n"])), re.compile("|".join([*escaped, *quote]) or r"(?!)")


def cut(text: str, dialect: Dialect, final: bool) -> tuple[list[str], str]:
    """(records, rest) of a text that begins at a record's start."""
    out, at, i, quoted = [], 0, 0, False
    outside, inside = _stops(dialect)
    while at < len(text):
        if i == at and not quoted and dialect.comment and text.startswith(dialect.comment, at):
            end = text.find("\n", at)
            if end < 0:
                break
            at = i = end + 1
            continue
        found = (inside if quoted else outside).search(text, i)
        if not found:
            break
        i = found.end()
        if found[0] == dialect.quote:
            quoted = not quoted
        elif found[0] == "\n":
            out.append(text[at : found.start()])
            at = i
    rest = text[at:]
    if final:
        if rest and not (dialect.comment and rest.startswith(dialect.comment)):
            out.append(rest)
        rest = ""
    return [r[:-1] if r.endswith("\r") else r for r in out], rest


def raw_groups(text: str, lines: int) -> tuple[list[str], str]:
    """(groups, rest) of a text that begins at a group's start; a group is the text of so many terminated lines, without its last newline."""
    parts = text.split("\n")
    whole = (len(parts) - 1) // lines * lines
    groups = ["\n".join(parts[k : k + lines]) for k in range(0, whole, lines)]
    if "\r" in text:
        groups = [x.replace("\r\n", "\n").removesuffix("\r") for x in groups]
    return groups, "\n".join(parts[whole:])


def cut_groups(text: str, lines: int) -> tuple[list[list[str]], str]:
    """(groups, rest) as of raw_groups(), groups as lists of lines."""
    found, rest = raw_groups(text, lines)
    return [x.split("\n") for x in found], rest


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stream, seq, chunk, eof) in which neighbours of one stream with successive seq are one row, at the first one's seq."""
    for batch in batches:
        if not batch.num_rows:
            continue
        stream, seq, chunk, eof = batch.columns
        follows = pc.and_(pc.equal(stream[1:], stream[:-1]), pc.equal(seq[1:], pc.add(seq[:-1].cast(pa.int64()), 1)))
        first = np.flatnonzero(np.append(True, ~follows.fill_null(False).to_numpy(zero_copy_only=False)))
        text = chunk.cast(pa.string()).fill_null("")
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1][np.append(first, len(text))]
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), text.buffers()[2])
        ended = np.logical_or.reduceat(eof.fill_null(False).to_numpy(zero_copy_only=False), first)
        yield pa.RecordBatch.from_arrays([stream.take(pa.array(first)), seq.take(pa.array(first)), text.cast(chunk.type), pa.array(ended)], batch.schema.names)


def _fold(take: Callable[[str, bool], tuple[list, str]], name: str, packed: bool = False) -> Callable:
    """What a bucket's call does with its chunks and state; take(text, final) gives what it finds and the rest that waits.

    With packed, a row has lists of values, few if they are long: Spark's Python takes as long over each row as the fold does over a
    stream, and holds 10,000 of them at a time.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits = {s: (rest, n) for s, rest, n in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("seq")
        texts: dict[str | None, list[str]] = {}
        for s, chunk in zip(rows["stream"].tolist(), rows["chunk"].fillna("").tolist(), strict=True):
            texts.setdefault(s, []).append(chunk)
        ended = set(rows.loc[rows["eof"].eq(True), "stream"].tolist())
        streams, numbers, values = [], [], []
        for s, pieces in texts.items():
            rest, n = waits.pop(s, ("", 0))
            found, rest = take(rest + "".join(pieces), s in ended)
            streams += [s] * len(found)
            numbers += range(n, n + len(found))
            values += found
            if s not in ended:
                waits[s] = rest, n + len(found)
        found = {"stream": streams, "rec_no": numbers, name: values}
        if packed:
            n = max(1, min(PACKED, PACKED_CHARS * len(values) // (1 + sum(map(len, values)))))
            found = {c: [x[k : k + n] for k in range(0, len(x), n)] for c, x in found.items()}
        yield pd.DataFrame(found)
        if waits:
            state.update((json.dumps([(s, *kept) for s, kept in waits.items()]),))
        elif state.exists:
            state.remove()

    return run


def _folded(chunks: DataFrame, take: Callable[[str, bool], tuple[list, str]], name: str, buckets: int) -> DataFrame:
    """Rows (stream, rec_no, name) of what take(text, final) finds in each stream."""
    schema = f"stream array<string>, rec_no array<bigint>, {name} array<string>"
    rows = chunks.select("stream", "seq", "chunk", "eof")
    dealt = rows.mapInArrow(_joined, rows.schema).select(F.pmod(F.xxhash64("stream"), F.lit(buckets)).alias("bucket"), "stream", "seq", "chunk", "eof")
    found = dealt.groupBy("bucket").applyInPandasWithState(_fold(take, name, True), schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.inline(F.arrays_zip("stream", "rec_no", name)))


def stream_records(chunks: DataFrame, dialect: Dialect, buckets: int = BUCKETS) -> DataFrame:
    """Rows (stream, rec_no, raw) of a streaming or batch DataFrame (stream, seq, chunk, eof)."""
    return _folded(chunks, lambda text, final: cut(text, dialect, final), "raw", buckets)


def stream_groups(chunks: DataFrame, dialect: Dialect, buckets: int = BUCKETS) -> DataFrame:
    """Rows (stream, rec_no, fields) of the same input: lines_per_record lines each; a last partial or unterminated group is dropped."""
    rows = _folded(chunks, lambda text, _: raw_groups(text, dialect.lines_per_record), "raw", buckets)
    return rows.select("stream", "rec_no", F.split("raw", "\n", -1).alias("fields"))


def sequenced(texts: DataFrame, size: int, stream: str = "stream", text: str = "text") -> DataFrame:
    """Rows (stream, seq, chunk, eof): texts cut into chunks of `size` characters, for tests and replays.

    Texts are dealt out before, as a table can be one file of one row group, that is one task.
    """
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select(F.col(stream).alias("stream"), F.col(text).alias("text")).repartition(tasks, "stream")
    n = F.greatest(F.ceil(F.length("text") / size).cast("int"), F.lit(1))
    rows = dealt.select("stream", "text", (n - 1).alias("last"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("stream", "seq", F.substr("text", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("last")).alias("eof"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir; a local one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix=f"{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replayed(chunks: DataFrame, dialect: Dialect) -> DataFrame:
    """The records of a batch of chunks, or groups of lines, run through the streaming operator until all input is taken.

    Chunks, state and records are kept in the session's shared checkpoint folder (a local one only where none is set).
    """
    spark = chunks.sparkSession
    folder = shared_folder(spark, "stream")
    chunks.write.parquet(f"{folder}/chunks")
    buckets = max(1, spark.read.parquet(f"{folder}/chunks").count() // BUCKET_CHUNKS)
    source = spark.readStream.schema(chunks.schema).parquet(f"{folder}/chunks")
    rows = (stream_groups if dialect.lines_per_record > 1 else stream_records)(source, dialect, buckets)
    out = rows.writeStream.format("parquet").option("path", f"{folder}/records")
    out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/records")
