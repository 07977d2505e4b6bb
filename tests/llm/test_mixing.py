import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing

WEIGHTS = (5, 2, 1)


def targets(sizes):
    """Sharing again and again, as the rule is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def documents(n, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "tiny", None]
    return [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1)))), sources[rng.randrange(5) if i % 40 else 5]) for i in range(n)]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_against_the_rule(make, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = documents(600) + [(9001, "x " * 50, "solo"), (9002, None, "a"), (9003, "", "zero")]
    got = mixing.mix(make(*docs).withColumn("size", F.lit(1)).withColumn("rate", F.lit(1))).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, _, _ in docs)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in docs}
    whole = {}
    for k, _, s in docs:
        whole[s] = whole.get(s, 0) + size[k]
    want, taken = targets(whole), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.01 * want[s], 5) or s == "solo"


def test_reruns_and_partitions_agree(make):
    docs = make(*documents(200))
    run = lambda d: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect())
    assert run(docs.repartition(7)) == run(docs.coalesce(1))


def test_stage_repeats_rows_as_often_as_taken(make):
    docs = make(*documents(120)).withColumn("rate", F.lit("mine")).withColumn("copies", F.lit("own"))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = mixing.copied(docs)
    assert got.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert count == {k: n for k, n in taken.items() if n}


def test_repeated_rows_and_no_documents(make):
    got = mixing.mix(make((1, "a b", "s"), (1, "a b", "s"), (None, "c", None))).collect()
    assert len(got) == 3
    assert mixing.mix(make()).count() == 0 and mixing.copied(make()).count() == 0


def test_joint_constraints_meet_both_margins(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", "z"]), rng.randint(1, 50)) for _ in range(400)]
    docs = spark.createDataFrame(rows, "source string, lang string, size bigint")
    total = sum(r[2] for r in rows)
    goals = {"source": {"a": total * 0.3, "b": total * 0.7}, "lang": {"x": total * 0.5, "y": total * 0.25, "z": total * 0.25}}
    x = mixing.newton_dual(docs, ["source", "lang"], goals)
    for i, c in enumerate(("source", "lang")):
        for v, goal in goals[c].items():
            got = sum(r[2] * math.exp(x["source"][r[0]] + x["lang"][r[1]]) for r in rows if r[i] == v)
            assert math.isclose(got, goal, rel_tol=1e-4)


def test_both_ways_of_solving_give_the_same_mix(make, monkeypatch):
    docs = make(*documents(300), (9003, "", "zero"))
    run = lambda: sorted(((r["doc_id"], r["taken"], round(r["rate"], 7)) for r in mixing.mix(docs).collect()), key=str)
    joint = run()
    monkeypatch.setattr(mixing, "MAX_CONSTRAINTS", 0)
    assert joint == run()
