import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_jaccard import plain
from tests.llm.test_quality import LABELS, texts


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rng, given = random.Random(3), texts(150)
    copies = [given[rng.randrange(150)] for _ in range(30)]
    near = [(t + " tail", q) for t, q in given[:20]]
    rows = [(i, t, f"s{i % 3}") for i, (t, _) in enumerate([*given, *copies, *near])]
    make(*rows, (900, None), (901, "")).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(k, q, 0) for k, (_, q) in enumerate(given)], LABELS).write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder).cache()
        was, now = before.collect(), after.collect()
        old = {r["doc_id"]: r for r in was}
        if k < 4:
            assert after.columns == columns and all(tuple(r) == tuple(old[r["doc_id"]]) for r in now)
        if name == "quality_classifier":
            bad = [r for r in was if re.search(r"!!|\$\$\$|###", r["text"] or "")]
            assert not {r["doc_id"] for r in bad} & {r["doc_id"] for r in now}
            assert len(now) >= len(was) - len(bad) - 3
        elif name == "exact_dedup":
            plain_text = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
            assert Counter(map(plain_text, now)) == Counter(set(map(plain_text, was)))
        elif name == "ngram_jaccard_join":
            want = {c if n else d for d, n, c in plain([(r["doc_id"], r["text"]) for r in was], 5, 80)}
            assert {r["doc_id"] for r in now} == want and len(now) == len(want)
        elif name == "mix_sources":
            assert len(now) > 0 and max(Counter(r["doc_id"] for r in now).values()) <= 3
        else:
            assert sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in was)
            assert all(len(np.frombuffer(bytes(r["ids"]), "<u4")) == r["n_tokens"] for r in now)
        before = after


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 10


def test_stages_take_empty_tables_and_further_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_score", F.lit(1)).withColumn("s", F.lit(2))
    for rows in (docs.limit(0), docs.limit(5)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, rows, folder).columns == docs.columns
            stage(spark, rows, folder).count()
