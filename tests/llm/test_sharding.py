import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


@pytest.mark.parametrize("shards,groups", [(8, [1] * 40), (8, [20, 10, 5, 3, 3, 2, 2, *[1] * 30]), (3, [50, 1, 1]), (8, [1, 2]), (4, [9, 9, 9, 9])])
def test_law_and_slots(make, shards, groups):
    texts = [f"text {g}" for g, n in enumerate(groups) for _ in range(n)]
    got = sharding.shard(make(*texts).withColumn("size", F.lit("x")).withColumn("shard", F.lit(1)), shards).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    held = Counter(r["shard"] for r in got)
    counts = [held.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text.encode()), "rows", None)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together_where_they_fit(make):
    texts = [f"text {g}" for g in range(40) for _ in range(3)] + [f"single {i}" for i in range(200)]
    got = sharding.shard(make(*texts)).collect()
    spread = defaultdict(set)
    for r in got:
        spread[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 2


def test_nulls_repeats_and_nothing(make):
    got = sharding.shard(make(None, "", (7, "é"), (7, "é"), (None, "x"))).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 3, 3]
    assert sharding.shard(make()).count() == 0


def test_groups_stay_together_beside_a_hot_one(make):
    texts = ["hot"] * 1000 + [f"pair {g}" for g in range(600) for _ in range(2)] + [f"ten {g}" for g in range(20) for _ in range(10)] + [f"single {i}" for i in range(600)]
    got = sharding.shard(make(*texts)).collect()
    spread = defaultdict(set)
    for r in got:
        spread[texts[r["doc_id"]]].add(r["shard"])
    assert set(Counter(r["shard"] for r in got).values()) == {375}
    assert len(spread.pop("hot")) == 3
    assert [t for t, s in spread.items() if len(s) > 1] == []
