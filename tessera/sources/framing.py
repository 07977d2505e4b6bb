"""Length-prefixed frames and block-compressed containers.

scan() walks one file's frame chain, which is sequential by nature but reads headers only. frames() does that for a
table of binary files, one row per frame; payloads are inflated by frame, spread over tasks; records that straddle
frames are stitched with window sums, see stitched_records().
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.cells import from_latin1, latin1

FRAME_COLUMNS = "frame_no bigint, start bigint, len bigint, payload_start bigint, payload_end bigint, uncompressed bigint"
_WIDTHS = {1: "B", 2: "H", 4: "I", 8: "Q"}
_MAX_VARINT = 10


class FramingError(ValueError):
    """Bytes that don't follow the framing, or a framing that can't be."""


@dataclass(frozen=True)
class SizeField:
    """Where a frame states its payload's uncompressed size; a negative place counts from the frame's end."""

    at: int
    width: int = 4
    endian: str = "le"


@dataclass(frozen=True)
class Framing:
    """How a stream is divided. width is 1, 2, 4, 8, or "varint"; counts is "total" or "payload"."""

    header: int
    length_at: int = 0
    width: int | str = 4
    endian: str = "le"
    counts: str = "payload"
    adjust: int = 0
    trailer: int = 0
    magic: tuple[int, bytes] | None = None
    skip_empty: bool = False
    uncompressed: SizeField | None = None

    def validate(self) -> Framing:
        if self.width != "varint" and self.width not in _WIDTHS:
            raise FramingError("width must be 1, 2, 4, 8 or varint")
        if self.counts not in ("total", "payload") or self.endian not in ("le", "be"):
            raise FramingError("counts must be total or payload, endian le or be")
        if min(self.header, self.length_at, self.trailer) < 0:
            raise FramingError("header, length_at and trailer must not be negative")
        if self.width != "varint" and self.length_at + self.width > self.header:
            raise FramingError("the length field must lie in the header")
        return self


#: The canonical layout of blocked gzip: total size less one at 16, inflated size at the end.
BGZF = Framing(18, 16, 2, "le", "total", 1, 8, (0, b"\x1f\x8b"), False, SizeField(-4))


@dataclass(frozen=True)
class Frame:
    start: int
    len: int
    payload_start: int
    payload_end: int
    uncompressed: int | None = None


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned LEB128 value and the bytes that it takes, ten at most."""
    value = 0
    for i in range(_MAX_VARINT):
        if at + i >= len(data):
            raise FramingError(f"the varint at {at} is cut off")
        value |= (data[at + i] & 0x7F) << 7 * i
        if not data[at + i] & 0x80:
            if value >= 1 << 64:
                raise FramingError(f"the varint at {at} is over 64 bits")
            return value, i + 1
    raise FramingError(f"the varint at {at} is longer than {_MAX_VARINT} bytes")


def _number(data: bytes, at: int, width: int, endian: str) -> int:
    if at < 0 or at + width > len(data):
        raise FramingError(f"a field at {at} lies outside the data")
    return struct.unpack_from(("<" if endian == "le" else ">") + _WIDTHS[width], data, at)[0]


def frame_at(framing: Framing, data: bytes, at: int) -> Frame:
    """The frame that begins at a place."""
    if framing.magic:
        where, want = framing.magic
        if data[at + where : at + where + len(want)] != want:
            raise FramingError(f"the frame at {at} lacks its magic bytes")
    if framing.width == "varint":
        value, used = read_varint(data, at + framing.length_at)
        head = framing.length_at + used + framing.header
    else:
        value, head = _number(data, at + framing.length_at, framing.width, framing.endian), framing.header
    value += framing.adjust
    size = value if framing.counts == "total" else head + value + framing.trailer
    if value < 0 or size < head + framing.trailer:
        raise FramingError(f"the frame at {at} is too short for its header and trailer")
    if at + size > len(data):
        raise FramingError(f"the frame at {at} runs past the end")
    plain = None
    if (f := framing.uncompressed) is not None:
        place = f.at if f.at >= 0 else size + f.at
        if place < 0 or place + f.width > size:
            raise FramingError(f"the size field of the frame at {at} lies outside it")
        plain = _number(data, at + place, f.width, f.endian)
    return Frame(at, size, at + head, at + size - framing.trailer, plain)


def scan(framing: Framing, data: bytes) -> Iterator[Frame]:
    framing.validate()
    at = 0
    while at < len(data):
        frame = frame_at(framing, data, at)
        if frame.len <= 0:
            raise FramingError(f"the frame at {at} is empty")
        if not (framing.skip_empty and frame.payload_start == frame.payload_end):
            yield frame
        at += frame.len


def scan_bgzf(data: bytes) -> Iterator[Frame]:
    """Blocked gzip whose extra field may hold other subfields; empty blocks are left out."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b" or len(data) < at + 12 or not data[at + 3] & 4:
            raise FramingError(f"the member at {at} is no block")
        extra = _number(data, at + 10, 2, "le")
        p, end, size = at + 12, at + 12 + extra, None
        while p + 4 <= min(end, len(data)):
            n = _number(data, p + 2, 2, "le")
            if data[p : p + 2] == b"BC" and n == 2:
                size = _number(data, p + 4, 2, "le") + 1
            p += 4 + n
        if size is None or at + size > len(data) or size < 20 + extra:
            raise FramingError(f"the block at {at} states no fitting size")
        plain = _number(data, at + size - 4, 4, "le")
        if plain:
            yield Frame(at, size, end, at + size - 8, plain)
        at += size


def write_bgzf(data: bytes, block: int = 60_000) -> bytes:
    """data as blocks, with the empty one that ends a file."""
    out = []
    for at in [*range(0, len(data), block), None]:
        part = b"" if at is None else data[at : at + block]
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(part) + press.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _inflate(payload: bytes) -> bytes:
    return zlib.decompress(payload, -15)


#: How payloads are decoded, by name; a caller may pass a function of its own.
DECODERS: dict[str, Callable[[bytes], bytes]] = {"none": bytes, "deflate": _inflate}


def frames(files: DataFrame, framing: Framing | str, content: str = "content", key: str = "path") -> DataFrame:
    """Rows (key, frame_no, start, len, payload_start, payload_end, uncompressed, payload), one for each frame.

    framing is a Framing, or "bgzf" for a scan of the extra field.
    """
    walk = scan_bgzf if framing == "bgzf" else lambda data: scan(framing, data)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for n, f in enumerate(walk(data or b"")):
                    rows.append({key: k, "frame_no": n, **vars(f), "payload": data[f.payload_start : f.payload_end]})
                    size += f.len
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([pa.field(key, files.select(key).limit(0).toArrow().schema.field(0).type)] + [pa.field(c.split()[0], pa.int64()) for c in FRAME_COLUMNS.split(", ")] + [pa.field("payload", pa.binary())])
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, {FRAME_COLUMNS}, payload binary")


def decoded(framed: DataFrame, decoder: str | Callable[[bytes], bytes] = "deflate", check_sizes: bool = False) -> DataFrame:
    """framed with each payload decoded, in the tasks that hold it. check_sizes: the stated size must be met."""
    decode = DECODERS[decoder] if isinstance(decoder, str) else decoder
    schema = framed.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, want = names.index("payload"), names.index("uncompressed")
        for batch in batches:
            out = [decode(p) for p in batch.column(at).to_pylist()]
            if check_sizes:
                for p, n in zip(out, batch.column(want).to_pylist(), strict=True):
                    if n is None or n != len(p):
                        raise FramingError(f"a frame states {n} bytes and holds {len(p)}")
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return framed.mapInArrow(run, schema)


def stitched_records(framed: DataFrame, key: str = "path", terminator: str = "\n") -> DataFrame:
    """Rows (key, rec_no, raw): whole records of decoded payloads, also where they straddle frames.

    Every piece of a payload after its first terminator begins a record; a running sum of the frames' counts numbers
    them. A piece between two terminators is a whole record and stays where it is; only what touches a frame's border
    is put together. The terminator is a raw byte here, whether quoted or not. What follows the last terminator is a
    record unless empty.
    """
    # one character a byte, so that a character may straddle frames
    pieces = F.split(latin1(F.col("payload")), rf"\Q{terminator}\E")
    counts = framed.select(key, "frame_no", (F.size(pieces) - 1).alias("_count"))
    before = Window.partitionBy(key).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    # numbers alone are ordered, no frame's text with another's
    counts = counts.withColumn("_first", F.coalesce(F.sum("_count").over(before), F.lit(0))).withColumn("_last", F.sum("_count").over(Window.partitionBy(key)))
    parts = framed.select(key, "frame_no", F.posexplode(pieces).alias("_piece", "_part"), (F.size(pieces) - 1).alias("_n"))
    parts = parts.join(counts.drop("_count"), [key, "frame_no"]).withColumn("_rec", F.col("_first") + F.col("_piece"))
    at_border = (F.col("_piece") == 0) | (F.col("_piece") == F.col("_n"))
    whole = parts.filter(~at_border).select(key, F.col("_rec").alias("rec_no"), from_latin1(F.col("_part")).alias("raw"))
    joined = parts.filter(at_border).groupBy(key, "_rec").agg(F.sort_array(F.collect_list(F.struct("frame_no", "_part"))).alias("_parts"), F.first("_last").alias("_last"))
    raw = F.array_join(F.transform("_parts", lambda p: p["_part"]), "")
    joined = joined.filter((F.col("_rec") < F.col("_last")) | (raw != "")).select(key, F.col("_rec").alias("rec_no"), from_latin1(raw).alias("raw"))
    return whole.unionByName(joined)


def read_frames(spark: SparkSession, path: str, framing: Framing | str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return frames(files, framing)


def read_bgzf_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, rec_no, raw) of blocked gzip files."""
    return stitched_records(decoded(read_frames(spark, path, "bgzf").repartition(F.col("path"), F.col("frame_no"))))


def fold_payloads(framed: DataFrame, init: Callable[[], object], process: Callable[[object, bytes], object], schema: str) -> DataFrame:
    """One row per task: what `process` makes of a state and each payload in turn, from init().

    The state returned must be a tuple of schema's columns; states of tasks are merged by an aggregate over the rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init()
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                state = process(state, payload)
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, state, strict=True)})

    return framed.select("payload").mapInArrow(run, schema)


def read_vcf_gz(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pos, quality, dp, af) of block-compressed VCF files; toArrow() gives them as one table."""
    from tessera.operators.columns import typed
    from tessera.sources.spec import SPECS

    return typed(read_bgzf_records(spark, path), SPECS["vcf_typed"]).select("pos", "quality", "dp", "af")
