"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

A text is split by the vocabulary's pattern; every distinct piece is encoded once. Pieces of like length
stand as rows of one padded matrix of token ids. In each round every row merges its leftmost pair of least
rank: ranks of pairs come from a hash table, the matrix is compacted by the merged column, and rows without
a mergeable pair leave. Only the two pairs beside a merge are looked up again. Pieces longer than LONG bytes, of
which a text may be one, are merged through a heap instead, whose work grows as n log n.

Encoded pieces are kept per worker, up to CACHE of them, so frequent words cost a dictionary lookup.

Nulls: a null text is empty and has no ids. Rows that repeat are encoded alike. Empty tables give no rows.
Ids that the vocabulary lacks can't be decoded and raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm import textbytes as tb
from tessera.llm.common import small_batches, table

#: Pieces of more bytes are merged through a heap.
LONG = 256
#: Cells of a matrix at most.
CELLS = 1 << 18
#: Encoded pieces that a worker keeps.
CACHE = 100_000
_NONE = np.int64(1) << 40
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids, a << 32 | b, in an open-addressing hash table, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(int(len(pairs) * 3).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 1
        while len(left):
            free = self.keys[at[left]] < 0
            spot, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[spot], self.values[spot] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self._home(keys)
        out = np.full(keys.shape, _NONE, np.int64)
        todo = np.arange(keys.size)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & self.mask
        return out


class Encoder:
    """ranks: the bytes of a rank file, of lines of a base64 token and its rank."""

    def __init__(self, ranks: bytes, pattern: str):
        lines = (x.split() for x in ranks.splitlines() if x)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.cache: dict[str, bytes] = {}

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece; positions link to their neighbours."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := self.pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def _matrix(self, pieces: list[bytes], out: list, at: list[int]) -> None:
        """Merge pieces of like length; out[at[i]] gets the ids of the i-th."""
        length = np.array([len(p) for p in pieces])
        width = int(length.max())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.single[flat].reshape(len(pieces), width)
        ids[np.arange(width) >= length[:, None]] = -1
        rank = np.full((len(pieces), width), _NONE)
        real = ids[:, 1:] >= 0
        rank[:, :-1][real] = self.table(ids[:, :-1][real], ids[:, 1:][real])
        row = np.array(at)
        while len(row):
            best = rank.argmin(1)
            each = np.arange(len(row))
            least = rank[each, best]
            done = least >= _NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done], strict=True):
                    out[r] = x[x >= 0]
                go = ~done
                ids, rank, row, best, least, each = ids[go], rank[go], row[go], best[go], least[go], np.arange(int(go.sum()))
                if not len(row):
                    break
            ids[each, best] = least
            keep = np.ones(ids.shape, bool)
            keep[each, best + 1] = False  # a mergeable pair has a right neighbour
            w = ids.shape[1] - 1
            ids, rank = ids[keep].reshape(-1, w), rank[keep].reshape(-1, w)
            # the pair that begins at the merged id, and the one that ends there
            for first in (best, best - 1):
                ok = (first >= 0) & (first + 1 < w)
                r, c = each[ok], first[ok]
                ok2 = ids[r, c + 1] >= 0
                value = np.full(len(r), _NONE)
                value[ok2] = self.table(ids[r[ok2], c[ok2]], ids[r[ok2], c[ok2] + 1])
                rank[r, c] = value
            last = best == w - 1
            rank[each[last], best[last]] = _NONE

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r])
            elif len(p) > LONG:
                out[i] = np.array(self._heap(p))
            else:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(CELLS // width, 1)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                self._matrix([pieces[i] for i in part], out, part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(pieces)
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            self.cache[p] = ids.astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        seen = set(pieces)
        if not seen <= self.cache.keys():
            self._learn(seen)
        return b"".join(map(self.cache.__getitem__, pieces))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """As encode(), with the new pieces of many texts encoded together."""
        split = [self.find(t) for t in texts]
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        if new - self.cache.keys():
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    held = tb.kept("bpe")
    if key not in held:
        held[key] = Encoder(ranks, pattern)
    return held[key]


def encoded(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Columns `keep` of docs, with n_tokens, ids (binary, if asked for), ids_sha256 and decoded_sha256.

    The vocabulary's bytes travel with the task, so workers need no file.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    own = [T.StructField("n_tokens", T.LongType())] + [T.StructField("ids", T.BinaryType())] * ids
    own += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *own])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern)
        for batch in batches:
            for part in tb.slices(batch, len(keep)):
                raw = bpe.encode_batch([t or "" for t in part.column(len(keep)).to_pylist()])
                made = [pa.array([len(x) // 4 for x in raw], pa.int64())] + [pa.array(raw, pa.binary())] * ids
                made.append(pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()))
                made.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in raw], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(tb.lean(run, "bpe"), schema)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """A public vocabulary's rank file and pattern, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes(), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), *vocabulary(), ids=False)
