"""The "framed" data source: spark.read.format("framed").option("framing", "bgzf").load(path).

Headers are walked when reads are planned; runs of frames become partitions, so one file is inflated by many tasks.
"""
from __future__ import annotations

import glob
import json
import mmap
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.framing import BGZF, DECODERS, FRAME_COLUMNS, Framing, SizeField, scan, scan_bgzf


def framing_option(text: str) -> Framing | str:
    """A framing from an option: "bgzf", "bgzf-canonical", or a JSON object of Framing's fields."""
    if text == "bgzf":
        return "bgzf"
    if text == "bgzf-canonical":
        return BGZF
    given = json.loads(text)
    if given.get("magic"):
        given["magic"] = (given["magic"][0], bytes.fromhex(given["magic"][1]))
    if given.get("uncompressed"):
        given["uncompressed"] = SizeField(**given["uncompressed"])
    return Framing(**given).validate()


class FrameRun(InputPartition):
    def __init__(self, path: str, first: int, frames: list):
        super().__init__(path)
        self.path, self.first, self.frames = path, first, frames


class FramedReader(DataSourceReader):
    def __init__(self, options):
        self.framing = framing_option(options.get("framing", "bgzf"))
        self.decode = options.get("decoder", "deflate" if self.framing in ("bgzf", BGZF) else "none")
        self.run = int(options.get("framesPerPartition", "256"))
        self.paths = sorted(p for given in options["path"].split(",") for p in glob.glob(given) or [given])

    def partitions(self):
        out = []
        for path in self.paths:
            found = self.scanned(path)
            out += [FrameRun(path, k, found[k : k + self.run]) for k in range(0, len(found), self.run)]
        return out or [FrameRun(self.paths[0], 0, [])]

    def scanned(self, path: str) -> list:
        """A file's frames; the file is mapped, so that headers alone are read."""
        if not os.path.getsize(path):
            return []
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return list(scan_bgzf(data) if self.framing == "bgzf" else scan(self.framing, data))

    def read(self, partition: FrameRun) -> Iterator[tuple]:
        decode = DECODERS[self.decode]
        with open(partition.path, "rb") as f:
            for n, x in enumerate(partition.frames, partition.first):
                f.seek(x.payload_start)
                payload = decode(f.read(x.payload_end - x.payload_start))
                yield partition.path, n, x.start, x.len, x.payload_start, x.payload_end, x.uncompressed, payload


class FramedSource(DataSource):
    """Files on a mounted file system; for stores that only Spark reads use framing.read_frames()."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return f"path string, {FRAME_COLUMNS}, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FramedReader(self.options)
