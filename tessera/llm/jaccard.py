"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct shingles of `width` words. Documents link when
100 * |intersection| >= percent * |union|; components of the links are the classes.

Equal sets (by 128 bits) are one from the start. Tokens have one global order: those common in a sample of the
documents come last. The order only decides how much is pruned, never what is found. A set's prefix is its first
n - ceil(percent * n / 100) + 1 + EXTRA tokens.

1. Sets are partitioned into groups of like ones, by the least token among those about as common as the prefix's
   most common one, so that most copies of one text have the same. A group is cut into chunks of bounded size. A chunk's own pairs are verified first, on whole
   texts, from its most typical set outwards: what links with that one need not ask again. Chunks of one key are then
   connected through one set of each of their components. So a class of m near copies costs about m, not m * m.
2. Each component is a group now; sets without links are bundled by chunk and size. The token-group matrix has a row
   (token, group) for each token in the union of the group's prefixes. Tokens of one group alone are dropped.
3. A set asks the groups that are larger than its own. The matrix gives the overlap of its prefix with the group's
   union, an upper bound for every member. By the prefix order, |intersection| <= overlap + the longer rest behind
   the prefixes, so a group is opened only if that can reach what its sizes ask for.
4. Opened groups are verified on whole texts, in blocks of bounded size. A set asks a group's first block; only
   if it is not connected with the group by then, it asks the others too.

Common tokens, which a large part of the sets may have, are aggregated before they are dealt out, and joined on a
salt. Texts travel compressed; where they are read, a mask of MASK_BITS bits drops the most of those that
nobody asks for, and a join drops the rest, at any number of documents.

Nulls: a null text is empty; a set without words links with nothing. Rows that share text share a class; rows
that share a doc_id too come out each. A null doc_id is its class's id only where all are null. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import SALTS, bit_mask, checkpointed, hot_keys, join_spread, keep_rows, mask_place, small_batches, table, uniform
from tessera.llm.components import components

#: One of so many documents is sampled for common tokens, those in at least SEEN sampled ones; COMMON at most.
SAMPLE, SEEN, COMMON = 16, 4, 1 << 20
#: Sampled documents from which on a token is joined on a salt.
HOT_SEEN = 32
#: Tokens of a prefix beyond those that one shared token needs; each asks for one more shared token.
EXTRA = 3
#: Sets and tokens of a chunk or block, about, and queries of a block.
GROUP_SETS, GROUP_TOKENS, BLOCK_QUERIES = 4096, 300_000, 4096
#: Sets without links in one group.
BUNDLE = 64
NO_LINKS = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, tokens, offsets) for runs of rows; each row's distinct shingle hashes ascend."""
    for first, last, data, offsets in tb.chunks(column):
        start, end, doc = tb.words(data, offsets)
        h = tb.word_hashes(data, start, end)
        values, doc = tb.shingles(h, doc, last - first, width)
        yield last - first, *tb.distinct_by_doc(values, doc, last - first)


def _identities(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers for each set; equal sets have equal ones."""
    n = np.diff(offsets).astype(np.uint64)

    def summed(hashed: np.ndarray) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)])
        return tb.mix((total[offsets[1:]] - total[offsets[:-1]]) * np.uint64(3) + n).view(np.int64)

    return summed(tb.mix(tokens + np.uint64(1))), summed(tb.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _common_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens common in a sample of the documents, ascending, with their counts; COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, offsets in _sets(batch.column(0), width):
                # copies count once, else a hot copy makes its own tokens common
                _, first = np.unique(_identities(tokens, offsets)[0], return_index=True)
                rows = _lists(tokens, np.diff(offsets)).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([rows], ["tokens"])

    small_batches(docs.sparkSession)
    some = docs.filter(uniform(F.xxhash64("text")) < 1 / SAMPLE).select("text").mapInArrow(tb.lean(run), "tokens array<bigint>")
    counted = some.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= SEEN)
    found = counted.orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    token = found["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found["count"].to_numpy()[order]


def _ceil_share(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _keys(tokens: np.ndarray, seen: np.ndarray, doc: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Each document's least token among those about as common as its prefix's most common one, of count `most`."""
    out = np.zeros(len(most), np.uint64)
    like = np.flatnonzero((2 * seen >= most[doc]) & (seen <= 2 * most[doc]))
    held, first = np.unique(doc[like], return_index=True)
    out[held] = tokens[like[first]]
    return out


def _prefixed(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (doc_id, text_hash, n, s, s2, key, prefix, hot): the set's size, identity, key, and prefix without and with hot tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = shared.value
        for batch in batches:
            at = 0
            for rows, tokens, offsets in _sets(batch.column(1), width):
                n = np.diff(offsets)
                doc = np.repeat(np.arange(rows), n)
                seen = np.zeros(len(tokens), np.int64)
                if len(token):
                    spot = np.minimum(np.searchsorted(token, tokens), len(token) - 1)
                    seen = np.where(token[spot] == tokens, count[spot], 0)
                plain, order = (tokens, seen, doc), np.lexsort((tokens, seen, doc))
                length = np.where(n > 0, np.minimum(n - _ceil_share(n, percent) + 1 + EXTRA, n), 0)
                place = np.arange(len(tokens)) - np.repeat(offsets[:-1], n)
                kept = place < np.repeat(length, n)
                tokens, seen, doc = tokens[order], seen[order], doc[order]
                key = _keys(*plain, np.where(n > 0, seen[np.maximum(offsets[:-1] + length - 1, 0)], 0) if len(seen) else n)
                hot = kept & (seen >= HOT_SEEN)
                rare = kept & ~hot
                each = lambda which: _lists(tokens[which], np.bincount(doc[which], minlength=rows))  # noqa: B023, E731
                s, s2 = _identities(tokens, offsets)  # sums, so the order does not matter
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), batch.column(2).slice(at, rows), pa.array(n, pa.int64()), pa.array(s), pa.array(s2), pa.array(key.view(np.int64)), each(rare), each(hot)],
                    ["doc_id", "text_hash", "n", "s", "s2", "key", "prefix", "hot"],
                )
                at += rows

    schema = "doc_id bigint, text_hash bigint, n bigint, s bigint, s2 bigint, key bigint, prefix array<bigint>, hot array<bigint>"
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tb.lean(run), schema)


def _texts(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """wanted (doc_id, text_hash, ...) with the documents' texts, compressed, and their sizes."""
    wanted = checkpointed(wanted)
    mask = docs.sparkSession.sparkContext.broadcast(bit_mask(wanted, "doc_id", "text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mask.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            kept = batch.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))
            for part in tb.slices(kept, 3):
                raw = [(x or "").encode() for x in part.column(3).to_pylist()]
                sizes = pa.array([len(x) for x in raw], pa.int64())
                packed = pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, sizes], ["_doc_id", "_text_hash", "data", "bytes"])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    given = given.select("doc_id", "text_hash", mask_place("doc_id", "text_hash").alias("place"), "text")
    texts = given.mapInArrow(tb.lean(run), "_doc_id bigint, _text_hash bigint, data binary, bytes bigint")
    if repeated:
        texts = texts.dropDuplicates(["_doc_id", "_text_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return wanted.join(texts, same).drop("_doc_id", "_text_hash", "doc_id", "text_hash")


class _Block:
    """Sets of a block's rows, with the sorted tokens of some of them, the members."""

    def __init__(self, block: pa.Table, width: int, members: np.ndarray):
        self.sets: list[np.ndarray] = []
        for part in block.select(["data", "bytes"]).to_batches(max_chunksize=256):
            raw = [pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            for _, tokens, offsets in _sets(pa.array(raw, pa.large_binary()), width):
                self.sets += [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.members = members
        self.sizes = np.array([len(self.sets[i]) for i in members], np.int64)
        tokens = np.concatenate([self.sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Places of the members that a set links with."""
        low, high = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        width = high - low
        some = width > 0
        low, width = low[some], width[some]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum()) if len(low) else low
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(both * (100 + percent) >= percent * (self.sizes + len(query)))

    def typical(self) -> np.ndarray:
        """The members' places, those whose tokens most others have first."""
        new = np.ones(len(self.tokens), bool)
        new[1:] = self.tokens[1:] != self.tokens[:-1]
        run = np.cumsum(new) - 1
        shared = np.bincount(run)[run]
        return np.argsort(-np.bincount(self.owner, weights=shared, minlength=len(self.sizes)) / self.sizes, kind="stable")


class _Forest(dict):
    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[b] = a
        return a != b


def _own(width: int, percent: int):
    """A chunk's sets with their group: the most typical set of their component, or the first of their bundle."""

    def run(block: pa.Table) -> pa.Table:
        sid, first = np.unique(block["sid"].to_numpy(), return_index=True)
        block = block.take(pa.array(first))
        held = _Block(block, width, np.arange(len(sid)))
        order, forest = held.typical().tolist(), _Forest()
        for i in order:
            # links with the first set's component are found from the other side
            if i == order[0] or forest.find(i) != forest.find(order[0]):
                for m in held.linked(held.sets[i], percent).tolist():
                    forest.join(i, m)
        parts: dict[int, list[int]] = {}
        for i in order:
            parts.setdefault(forest.find(i), []).append(i)
        group, single = np.zeros(len(sid), np.int64), np.zeros(len(sid), bool)
        alone = sorted((p[0] for p in parts.values() if len(p) == 1), key=lambda i: (int(held.sizes[i]), int(sid[i])))
        size, head = 0, 0
        for k, i in enumerate(alone):
            size += int(held.sizes[i])
            if k == 0 or k - head >= BUNDLE or size > GROUP_TOKENS:
                head, size = k, int(held.sizes[i])
            group[i], single[i] = sid[alone[head]], True
        for p in parts.values():
            if len(p) > 1:
                group[p] = sid[p[0]]
        return pa.table({"sid": sid, "g": group, "single": single})

    return run


def _asked(width: int, percent: int):
    """Links (a, b) of a block's queries with its members, as nodes, enough to connect what is linked."""

    def run(block: pa.Table) -> pa.Table:
        query = np.array(block["query"].to_pylist(), bool)
        if query.all() or not query.any():
            return NO_LINKS
        held, node = _Block(block, width, np.flatnonzero(~query)), block["node"].to_pylist()
        forest, links = _Forest(), []
        of_members = {node[i] for i in held.members.tolist()}
        for q in np.flatnonzero(query).tolist():
            if len(of_members) == 1 and forest.find(node[q]) == forest.find(next(iter(of_members))):
                continue
            for m in held.linked(held.sets[q], percent).tolist():
                if forest.join(node[q], other := node[held.members[m]]):
                    links.append((node[q], other))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _opens(overlap: str, n: str, low: str, high: str, percent: int, extra: int = 0) -> str:
    """SQL: whether a set of size n, with that overlap of prefixes, may link with one of some size in low..high."""
    p, q = percent, 100 + percent
    rest = lambda m: f"greatest(ceil({p} * {m} / 100) - {1 + extra}, 0)"
    need = lambda m: f"(ceil({p} * ({n} + {m}) / {q}) - greatest({rest(n)}, {rest(m)}))"
    least, most = f"greatest({low}, ceil({p} * {n} / 100))", f"least({high}, floor(100 * {n} / {p}))"
    # the need grows with the other's size m up to n; beyond n it is floor(p * (100 * n - p * m) / (100 * q)) + 1 + extra, which
    # falls, or one more. So an overlap short of both ends is compared with all sizes, if it reaches that floor, or
    # if the sizes are so small that prefixes are whole sets
    ends = f"{overlap} >= least({need(f'({least})')}, {need(f'({most})')})"
    floor = f"({overlap} > floor({p} * (100 * {n} - {p} * {most}) / {100 * q}) + {extra} or {p} * {least} <= {100 * (1 + extra)})"
    return f"({ends} or ({floor} and {least} <= {most} and exists(sequence(cast({least} as bigint), cast({most} as bigint)), m -> {overlap} >= {need('m')})))"


def _chunks(members: str, tokens: str):
    """Blocks that so many sets with so many tokens make."""
    return F.least(F.greatest(F.ceil(F.col(members) / GROUP_SETS), F.ceil(F.col(tokens) / GROUP_TOKENS)), F.col(members)).cast("int")


def _grouped(docs: DataFrame, sets: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """Rows (sid, g, single): the groups that the sets' own pairs give; sets that share no key are left out."""
    found, links = None, None
    now = sets.select("sid", "n", "key", "doc_id", "text_hash")
    while True:
        keys = now.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).filter("members > 1")
        keys = checkpointed(keys.select("key", "members", _chunks("members", "tokens").alias("chunks")))
        chunk = F.xxhash64("key", F.pmod(F.xxhash64("sid"), F.col("chunks"))).alias("chunk")
        wanted = join_spread(now, keys, "key", hot_keys(keys, "key", "members")).select("doc_id", "text_hash", "sid", chunk)
        own = checkpointed(_texts(docs, wanted, repeated).groupBy("chunk").applyInArrow(tb.lean_group(_own(width, percent)), "sid bigint, g bigint, single boolean"))
        if found is None:
            found = own
        else:
            new = own.filter("not single and sid <> g").select(F.col("sid").alias("a"), F.col("g").alias("b"))
            links = new if links is None else links.unionByName(new)
            if not new.limit(1).count():
                break
        many = keys.filter("chunks > 1").select("key")
        if not many.limit(1).count():
            break
        # one set of each component of a key with several chunks goes on; each round leaves half of them at most
        heads = own.filter("not single and sid = g").select("sid")
        now = checkpointed(now.join(heads, "sid").join(many, "key").select(*now.columns))
    if links is None:
        return found
    roots = components(links).select(F.col("node").alias("g"), "root")
    return found.join(roots, "g", "left").select("sid", F.coalesce("root", "g").alias("g"), "single")


def _overlaps(posts: DataFrame, hot: DataFrame, labels: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """Rows (sid, g, n, overlap, low, high): sets and larger groups that share tokens of their prefixes.

    posts and hot have rows (token, sid, g), the latter of hot tokens; labels rows (sid, n, members).
    """
    asks = F.expr(f"(members < size or members = size and g < other) and 100 * high >= {percent} * n and {percent} * low <= 100 * n")
    span = spans.select(F.col("g").alias("other"), "low", "high", F.col("members").alias("size"))
    by_token = Window.partitionBy("token")
    # tokens of one group alone bring no one together
    posts = posts.withColumn("_a", F.min("g").over(by_token)).withColumn("_b", F.max("g").over(by_token)).filter("_a <> _b").drop("_a", "_b")
    posts = checkpointed(posts)
    matrix = posts.select("token", F.col("g").alias("other")).distinct().join(span, "other")
    pairs = posts.join(labels, "sid").join(matrix, "token").filter(asks).select("sid", "n", "other", "low", "high")
    hot = checkpointed(hot)
    common = hot.select("token", F.col("g").alias("other")).distinct()
    several = common.groupBy("token").count().filter("count > 1").select("token")
    common = common.join(several, "token").join(span, "other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hot.join(labels, "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
    more = salted.join(common, ["token", "salt"]).filter(asks).select("sid", "n", "other", "low", "high")
    both = pairs.unionByName(more).groupBy("sid", F.col("other").alias("g"))
    return both.agg(F.first("n").alias("n"), F.count("*").alias("overlap"), F.first("low").alias("low"), F.first("high").alias("high"))


def _verified(docs: DataFrame, opened: DataFrame, labels: DataFrame, first: bool, width: int, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) between nodes from pairs (sid, g) of sets and groups that they ask, by the first block or by the others."""
    asked = opened.join(labels.select("sid", "n"), "sid").groupBy("g")
    asked = asked.agg(F.greatest(F.ceil(F.count("*") / BLOCK_QUERIES), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int").alias("queries"), F.count("*").alias("rows"))
    size = labels.filter("not single").groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    group = asked.join(size, "g", "left").select("g", "queries", "rows", "members", F.coalesce(_chunks("members", "tokens"), F.lit(1)).alias("chunks"))
    group = checkpointed(group)
    hot = sorted({*hot_keys(group, "g", "rows"), *hot_keys(group.filter("members is not null"), "g", "members")})
    group = group.select("g", "queries", "chunks")
    who = labels.select("sid", "node", "doc_id", "text_hash")
    chunk = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    members = join_spread(labels.select(*who.columns, "g"), group, "g", hot).withColumn("chunk", chunk)
    members = members.filter(F.col("chunk") == 0 if first else F.col("chunk") > 0)
    answer = members.select("g", "chunk", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("block"), F.lit(False).alias("query"), *who.columns)
    some = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("chunks") - 1)
    asking = join_spread(opened.select("sid", "g"), group if first else group.filter("chunks > 1"), "g", hot)
    block = F.pmod(F.xxhash64("sid"), F.col("queries")).cast("int")
    asking = asking.select("sid", "g", F.explode(some).alias("chunk"), block.alias("block"), F.lit(True).alias("query")).join(who, "sid")
    texts = _texts(docs, answer.unionByName(asking).drop("sid"), repeated)
    return texts.groupBy("g", "chunk", "block").applyInArrow(tb.lean_group(_asked(width, percent)), "a bigint, b bigint")


def _classes(docs: DataFrame, found: DataFrame, sets: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """Rows (sid, root): each set with its class; found has the prefixes by rid."""
    groups = checkpointed(_grouped(docs, sets, width, percent, repeated))
    single = F.coalesce("single", F.lit(True))
    labels = sets.select("sid", "n", "doc_id", "text_hash").join(groups, "sid", "left").withColumn("single", single).withColumn("g", F.coalesce("g", "sid"))
    labels = checkpointed(labels.withColumn("node", F.when(F.col("single"), F.col("sid")).otherwise(F.col("g"))))
    spans = checkpointed(labels.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members")))
    sized = checkpointed(join_spread(labels.select("sid", "n", "g"), spans.select("g", "members"), "g", hot_keys(spans, "g", "members")))
    posts = lambda c: found.filter(F.size(c) > 0).select(F.col("rid").alias("sid"), c).join(sized.select("sid", "g"), "sid").select(F.explode(c).alias("token"), "sid", "g")
    opened = _overlaps(posts("prefix"), posts("hot"), sized.select("sid", "n", "members"), spans, percent)
    opened = checkpointed(opened.filter(F.expr(_opens("overlap", "n", "low", "high", percent, EXTRA))).select("sid", "g"))
    links = checkpointed(_verified(docs, opened, labels, True, width, percent, repeated))
    roots = components(links)
    large = labels.filter("not single").groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).filter(_chunks("members", "tokens") > 1).select("g")
    apart = opened.join(large, "g")
    if apart.limit(1).count():
        # those that the first block has not connected
        roots = checkpointed(roots)
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        apart = apart.join(labels.select("sid", "node"), "sid").join(of("node"), "node", "left").join(of("g"), "g", "left")
        apart = checkpointed(apart.filter(F.coalesce("_node", "node") != F.coalesce("_g", "g")).select("sid", "g"))
        more = _verified(docs, apart, labels, False, width, percent, repeated)
        roots = components(checkpointed(links.unionByName(more)))
    return labels.join(roots, "node", "left").select("sid", F.coalesce("root", "node").alias("root"))


def _classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, text_hash, best), one per document; best is the class's least (doc_id, text_hash)."""
    docs = docs.select("doc_id", "text")
    found = checkpointed(_prefixed(docs, width, percent, _common_tokens(docs, width)).withColumn("rid", F.monotonically_increasing_id()))
    full = found.filter("n > 0")
    sets = full.groupBy("s", "s2").agg(
        F.min("rid").alias("sid"), F.first("n").alias("n"), F.first("key").alias("key"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count("*").alias("copies")
    )
    sets = checkpointed(sets)
    repeated = full.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count() > 0
    classes = checkpointed(_classes(docs, found, sets.select("sid", "n", "key", "row.doc_id", "row.text_hash"), width, percent, repeated))
    members = sets.select("sid", "s", "s2", "least", "row", "copies").join(classes, "sid")
    heads = checkpointed(members.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("best"), F.count("*").alias("members")))
    names = join_spread(members.select("s", "s2", "copies", "root"), heads.drop("members"), "root", hot_keys(heads, "root", "members"))
    names = checkpointed(names.drop("root"))
    rows = full.select("doc_id", F.col("n").alias("n_shingles"), "s", "s2", "text_hash")
    out = join_spread(rows, names.drop("copies"), ["s", "s2"], hot_keys(names, "s", "copies")).drop("s", "s2")
    return out.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.struct("doc_id", "text_hash").alias("best")))


def jaccard_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, text_hash), one per document."""
    return _classified(docs, width, percent).select("doc_id", "n_shingles", "component_id", "text_hash")


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each class the row with the smallest doc_id (then text hash), with all its columns; texts without words stay.

    Rows that repeat a doc_id and a text are one.
    """
    best = F.struct("doc_id", "text_hash").eqNullSafe(F.col("best"))
    return keep_rows(docs, _classified(docs, width, percent).select("doc_id", "text_hash", best.alias("kept")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), width=4, percent=85).drop("text_hash")
