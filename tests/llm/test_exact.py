import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact


def plain(docs):
    key = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    out = []
    for (k, t), x in zip(docs, key):
        group = [(-len(u or ""), v) for (v, u), y in zip(docs, key) if y == x]
        out.append((k, min(group)[1], len(group), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block,hot", [(4, 3), (4, 1000), (4096, 200)])
def test_against_brute_force(spark, make, monkeypatch, block, hot):
    monkeypatch.setattr(exact, "BLOCK", block)
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    rng = random.Random(block)
    base = ["", None, " \n\t", "abcd", "abc d", "a\x0bbcd", "abcdabcd", "abcdabcdabcd", "abcdabcdabc", "dcba" * 7, "é🙂" * 5, " ", "x" * 40]
    docs = [(i, b) for i, b in enumerate(base * 4)] + [(1000 + i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rng.shuffle(docs)
    got = exact.deduplicate(make(*docs).withColumn("_name", F.lit(1)).withColumn("group_size", F.lit("x"))).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == plain(docs)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_repeated_rows_and_null_ids(make):
    docs = make((1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "d"))
    got = exact.deduplicate(docs).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    assert sum(r["kept"] for r in got if r["doc_id"] == 1) == 1
    kept = exact.keep_one(docs.withColumn("_row", F.lit(1)).withColumn("_id", F.lit(2)))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c"), (0, "d"), (1, "a b")]
    assert kept.columns == [*docs.columns, "_row", "_id"]


def test_no_documents(make):
    assert exact.deduplicate(make()).count() == 0 and exact.keep_one(make()).count() == 0


def test_the_least_id_and_null_ids_win_ties(make):
    docs = make((-(1 << 63), "a b"), (5, "ab "), (None, "x y"), (2, "xy "), (7, "z"), (7, "z"))
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.deduplicate(docs).collect()}
    assert got == {(-(1 << 63), -(1 << 63), True), (5, -(1 << 63), False), (None, None, True), (2, None, False), (7, 7, True), (7, 7, False)}
