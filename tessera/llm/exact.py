"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of BLOCK code points. Equal blocks get one integer name: blocks are
dealt into buckets by hash, sorted, and named by bucket and rank. Then adjacent names are named in pairs, level
by level, until each document has one name; with its count of blocks that is its identity. Two documents have
the same identity only if all blocks are equal: no hash decides, so there are no collisions.

Skew: blocks that many documents share are found by counting block hashes. Those with over HOT_SHARE of all
blocks are few by construction; their distinct contents, which partial aggregates collapse before the shuffle,
are named apart and broadcast; a group of equal texts with such a share is joined the same way. Pairs of names are named on distinct pairs and joined back, a join whose
large partitions Spark can split.

Nulls: a null text is empty; empty texts are equal. A null doc_id sorts first. Rows that repeat are
copies like others: each comes out, and one stays. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import HOT_ROWS, HOT_SHARE, checkpointed, hot_keys, join_spread, keep_rows, partitions, table

#: Code points of a block.
BLOCK = 4096
#: Name bits of the rank in a bucket.
_RANK_BITS = 40
_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, "")


def _blocks(text: Column) -> Column:
    """The text's blocks; an empty text has one, which is empty."""
    n = F.greatest(F.ceil(F.length(text) / F.lit(BLOCK)).cast("int"), F.lit(1))
    cut = lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK))
    # most texts have one block and need no loop
    return F.when(n == 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cut))


def _named(df: DataFrame, cols: list[str], buckets: int, base: int) -> DataFrame:
    """Distinct values of cols with an integer _name: their bucket, then their rank in it."""
    bucket = F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*cols)).cast("long")
    found = df.select(*cols).distinct().withColumn("_bucket", bucket)
    return found.select(*cols, (F.shiftleft((F.col("_bucket") + base).cast("long"), _RANK_BITS) + rank).alias("_name"))


def name_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """blocks with _block replaced by its integer _name."""
    hashes = checkpointed(blocks.groupBy(F.xxhash64("_block").alias("_h")).agg(F.count("*").alias("_n")))
    total = hashes.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = [r["_h"] for r in hashes.filter(F.col("_n") >= least).collect()]  # at most 1 / HOT_SHARE
    by_rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy("_block")).cast("long")
    bucket = F.pmod(F.xxhash64("_block"), F.lit(buckets)).cast("int")
    name = F.shiftleft(F.col("_bucket").cast("long"), _RANK_BITS) + by_rank
    if not hot:
        return blocks.withColumn("_bucket", bucket).withColumn("_name", name).drop("_bucket", "_block")
    names = checkpointed(_named(blocks.filter(F.xxhash64("_block").isin(hot)), ["_block"], 1, buckets))
    named = blocks.join(F.broadcast(names.withColumnRenamed("_name", "_hot")), "_block", "left")
    # the named rows leave their block behind and are dealt evenly
    spread = F.pmod(F.xxhash64("_key", "_at"), F.lit(buckets)).cast("int")
    named = named.withColumn("_bucket", F.when(F.col("_hot").isNull(), bucket).otherwise(spread))
    named = named.withColumn("_block", F.when(F.col("_hot").isNull(), F.col("_block")))
    return named.withColumn("_name", F.coalesce("_hot", name)).drop("_bucket", "_block", "_hot")


def identities(texts: DataFrame) -> DataFrame:
    """Rows (_key, _blocks, _name, *carried) from rows (_key, _text, *carried).

    (_blocks, _name) are equal exactly for equal texts. Rows that share a _key must share the text.
    """
    buckets = max(partitions(texts.sparkSession) * 4, 64)
    carried = [c for c in texts.columns if c not in ("_key", "_text")]
    blocks = texts.select("_key", *carried, F.posexplode(_blocks(F.col("_text"))).alias("_at", "_block"), F.greatest(F.ceil(F.length("_text") / F.lit(BLOCK)), F.lit(1)).alias("_blocks"))
    # what the document carries stays with its first block
    blocks = blocks.select("_key", "_at", "_block", "_blocks", *[F.when(F.col("_at") == 0, F.col(c)).alias(c) for c in carried])
    named = checkpointed(name_blocks(blocks, buckets))
    whole = named.filter("_blocks = 1").drop("_at")
    firsts = named.filter("_blocks > 1 and _at = 0").drop("_at", "_name")
    level = named.filter("_blocks > 1").select("_key", F.col("_at").cast("long").alias("_at"), "_name", "_blocks")
    most = level.agg(F.max("_blocks")).first()[0] or 1
    while most > 1:
        half = F.shiftright("_at", 1)
        even = F.col("_at") % 2 == 0
        # a block without a partner is paired with 0, which names nothing
        pairs = level.groupBy("_key", half.alias("_at")).agg(
            F.max(F.when(even, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(0)).alias("_b")
        )
        level = checkpointed(pairs.join(_named(pairs, ["_a", "_b"], buckets, 0), ["_a", "_b"]).select("_key", "_at", "_name"))
        most = (most + 1) // 2
    joined = firsts.join(level.select("_key", "_name"), "_key")
    return whole.unionByName(joined.select(*whole.columns))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256, text_hash), one per document.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.
    """
    plain = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_chars"), normalised(F.col("text")).alias("_text"), F.xxhash64("text").alias("text_hash"))
    texts = plain.select(F.struct("doc_id", F.xxhash64("_text").alias("h")).alias("_key"), "_text", "doc_id", "_chars", "text_hash", F.sha2("_text", 256).alias("text_sha256"))
    # of rows that repeat the best one the first stays; they are numbered before the join, which may split a hot group
    again = Window.partitionBy("doc_id", "_blocks", "_name", "_chars").orderBy("text_hash")
    found = checkpointed(identities(texts).drop("_key").withColumn("_again", F.row_number().over(again)))
    best = F.min(F.struct((-F.col("_chars")).alias("less"), F.col("doc_id").alias("id")))
    groups = checkpointed(found.groupBy("_name", "_blocks").agg(best.alias("_best"), F.count("*").alias("group_size")))
    out = join_spread(found, groups, ["_name", "_blocks"], hot_keys(groups, "_name", "group_size"))
    is_best = F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("_chars") == -F.col("_best.less"))
    return out.select("doc_id", F.col("_best.id").alias("keep_id"), "group_size", (is_best & (F.col("_again") == 1)).alias("kept"), "text_sha256", "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, deduplicate(docs).select("doc_id", "text_hash", "kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("text_hash")


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) = 1 AS kept,
  sha256(t) AS text_sha256
FROM n
"""
