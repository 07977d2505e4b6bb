"""Bitstream programs over documents: one bit for each byte, each node a function of earlier ones.

Nodes are evaluated with numpy over a document at a time, in the tasks that hold it. Use the Catalyst forms of
nested.structural_index() where a dialect describes the format; this runs programs that none does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.sources.modules import Module, Node


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two bitstreams as numbers, whose carries ripple upwards."""
    n = len(a)
    whole = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    total = (whole(a) + whole(b)) & ((1 << n) - 1)
    raw = np.frombuffer(total.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.unpackbits(raw, bitorder="little", count=n).astype(bool)


def _regions(quotes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions from a region's opening up to its close: quoted, or a comment up to a terminator."""
    out = np.zeros(len(quotes), bool)
    begun, closing = -1, None
    for p in np.flatnonzero(quotes | starts | ends).tolist():
        if begun >= 0:
            if closing[p]:
                out[begun:p] = True
                begun = -1
        elif quotes[p] or starts[p]:
            begun, closing = p, quotes if quotes[p] else ends
    if begun >= 0:
        out[begun:] = True
    return out


def _shift(x: np.ndarray, first: bool) -> np.ndarray:
    return np.concatenate([[first], x[:-1]]) if len(x) else x


def evaluate(nodes: tuple[Node, ...], data: bytes) -> list[np.ndarray]:
    """Every node's bits over data."""
    raw, out = np.frombuffer(data, np.uint8), []
    for node in nodes:
        args = [out[a] for a in node.args]
        if node.op == "class":
            table = np.zeros(256, bool)
            table[list(node.value)] = True
            bits = table[raw]
        elif node.op == "const":
            pattern = np.array([node.value >> i & 1 for i in range(64)], bool)
            bits = pattern[np.arange(len(raw)) % 64]
        else:
            bits = _OPS[node.op](*args)
        out.append(bits)
    return out


_OPS = {
    "not": np.logical_not,
    "and": np.logical_and,
    "or": np.logical_or,
    "xor": np.logical_xor,
    "shl1": lambda x: _shift(x, False),
    "shl1-seeded": lambda x: _shift(x, True),
    "prefix-xor": lambda x: np.cumsum(x) % 2 == 1,
    "add": _add,
    "regions": _regions,
}


def positions(docs: DataFrame, content: str, module: Module, key: str, end: str = "output") -> DataFrame:
    """Rows (key, tape_idx, pos): where the program's output (or another end) is set, in order."""
    schema = T.StructType([docs.schema[key], T.StructField("tape_idx", T.IntegerType()), T.StructField("pos", T.LongType())])
    nodes, at = module.nodes, module.ends[end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                pos = np.flatnonzero(evaluate(nodes, data or b"")[at])
                keys = batch.column(0).take(pa.array(np.full(len(pos), i)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(len(pos)), pa.int32()), pa.array(pos, pa.int64())], schema.names)

    return docs.select(key, docs[content].cast("binary")).mapInArrow(run, schema)
