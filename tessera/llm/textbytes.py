"""Vectorised work on the UTF-8 bytes of many texts at once.

Arrow keeps a batch's texts in one buffer with offsets; these functions read that buffer with numpy, without
making Python strings. Batches are cut by bytes, so memory is bounded however long the texts are, but for
a single text, which is held whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Bytes of a group from which on its memory is given back when it is done.
LARGE_GROUP = 1 << 18
#: What worker processes keep between tasks, by the operator that uses it.
_KEPT: dict[str, dict] = {}
#: White space as the word pattern has it: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A random odd multiplier for each use; fixed, so that hashes agree between runs and machines.
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 300, dtype=np.uint64) * 2 + 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of the column's rows of about limit bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes, so that results leave early."""
    for first, last, _, _ in chunks(batch.column(column), limit):
        yield batch.slice(first, last - first)
    pa.default_memory_pool().release_unused()


def kept(name: str) -> dict:
    """The dictionary in which an operator keeps things between the tasks of a worker process; other operators' stages empty it."""
    return _KEPT.setdefault(name, {})


def begin(name: str | None) -> None:
    """Drop what other operators keep in this process."""
    for other, held in _KEPT.items():
        if other != name:
            held.clear()


def give_back() -> None:
    """Return freed memory to the system. Workers are reused and wait beside later stages, and C's allocator keeps what is freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(run: Callable, name: str | None = None) -> Callable:
    """A function of batches for mapInArrow that drops what other operators keep, and gives memory back after the last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """As lean(), for a function of one group's table."""

    def wrapped(block: pa.Table) -> pa.Table:
        begin(None)
        out = run(block)
        if block.nbytes >= LARGE_GROUP:
            give_back()
        return out

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of every word; words end at white space and at the texts' ends."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; equal words (after lower-casing A-Z) have equal hashes.

    Eight bytes at a time, over the words that are that long, so the work follows the bytes.
    """
    data = _LOWER[data] if lower else data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # the 8 bytes from each position on, as one integer
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, step = np.arange(len(start)), 0
    while len(todo):
        at = start[todo] + 8 * step
        block = np.ascontiguousarray(window[at]).view("<u8").ravel()
        left = length[todo] - 8 * step
        short = np.minimum(left, 8).astype(np.uint64)
        block = block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        h[todo] = mix(h[todo] * _MIX[0] + block)
        todo, step = todo[left > 8], step + 1
    return h


def shingles(h: np.ndarray, doc: np.ndarray, docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of width words, sorted by doc; a text with fewer words has one of all its words."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=docs)
    out = np.zeros(len(h), np.uint64)
    total = len(h)
    for k in range(min(width, total)):
        out[: total - k] = mix(out[: total - k] * _MIX[1] + h[k:])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    whole = (np.arange(total) - first[doc]) <= (n[doc] - width)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        value = np.full(len(short), 0xD6E8FEB86659FD93, np.uint64) + n[short].astype(np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            value[has] = mix(value[has] * _MIX[2] + h[first[short[has]] + k])
        out[first[short]] = value
        whole[first[short]] = True
    return out[whole], doc[whole]


def distinct_by_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each document's distinct values in ascending order."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])
