import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm import textbytes as tb

LABELS = "doc_id bigint, quality int, toxic int"


def texts(n):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "tree", "Stone", "water,", "goes."]) for _ in range(rng.randint(3, 200)))
    bad = lambda: " ".join(rng.choice(["THE!!", "BUY!!", "x$$$", "y###"]) for _ in range(rng.randint(3, 200)))
    return [(good(), 1) if rng.random() < 0.8 else (bad(), 0) for _ in range(n)]


def test_learns_and_holds_out(spark, make, tmp_path):
    given = texts(400)
    make(*[t for t, _ in given], None, "").withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    # labels of held-out rows are turned round: they must not be learned from
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(402)]
    spark.createDataFrame([(k, 1 - q if held[k] else q, 0) for k, (_, q) in enumerate(given)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert [got[k]["held_out"] for k in range(402)] == held
    assert np.mean([got[k]["predicted"] == q for k, (_, q) in enumerate(given)]) > 0.98


def test_without_two_classes_every_score_is_half(spark, make):
    docs = make("a", "b", None)
    for rows in ([], [(0, 1, 0), (1, 1, 0)], [(0, None, 0), (None, 0, 0)]):
        model = quality.train(docs, spark.createDataFrame(rows, LABELS))
        assert {round(r["score"], 12) for r in quality.scored(docs, model).collect()} == {0.5}
    assert quality.scored(docs.limit(0), quality.constant_model()).count() == 0


def test_features_do_not_depend_on_how_texts_are_cut(monkeypatch):
    column = pa.array([t for t, _ in texts(60)] + [None, "", " \n", "é" * 50])
    whole = quality.features(column)
    monkeypatch.setattr(tb, "chunks", lambda c, limit=7, f=tb.chunks: f(c, 7))
    assert np.allclose(whole, quality.features(column)) and whole.shape == (64, len(quality.FEATURES))
    assert not whole[-3].any() and not whole[-4].any()


def test_words_and_shingles_of_bytes():
    column = pa.array([None, "", "a", "A  b\tc d e", " x y ", "é ü\nz"])
    for limit in (1, 1000):
        n = []
        for first, last, data, offsets in tb.chunks(column, limit):
            start, end, doc = tb.words(data, offsets)
            assert not tb.IS_SPACE[data[start]].any() and not tb.IS_SPACE[data[end - 1]].any()
            h = tb.word_hashes(data, start, end)
            values, at = tb.shingles(h, doc, last - first, 4)
            n += [(int((doc == i).sum()), int((at == i).sum())) for i in range(last - first)]
        assert n == [(0, 0), (0, 0), (1, 1), (5, 2), (2, 1), (3, 1)]


def test_weights_minimise_the_pairwise_loss(monkeypatch):
    monkeypatch.setattr(quality, "STEP_PAIRS", 7)
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 5))
    good = z[:, 0] - z[:, 1] + rng.normal(size=40) > 0
    a, b = quality.preferences(np.flatnonzero(good), np.flatnonzero(~good))
    assert good[a].all() and not good[b].any() and len(a) == quality.PAIRS_EACH * max(good.sum(), (~good).sum())

    def loss(w):
        return np.mean([np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in zip(a, b)]) + 0.01 * w @ w / 2

    w = quality.ranking(z, a, b, 0.01)
    least = loss(w)
    for k in range(5):
        for step in (1e-3, -1e-3, 0.1, -0.1):
            assert loss(w + step * np.eye(5)[k]) > least


def test_words_alone_can_tell(make, spark):
    """The same letters, lengths and marks in either class; only the words differ."""
    rng = random.Random(4)
    words = ["lemon", "table", "ocean", "paper", "river"], ["melon", "bleat", "canoe", "prape", "virer"]
    docs = [" ".join(rng.choice(words[k % 2]) for _ in range(30)) for k in range(400)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(400)], LABELS)
    got = quality.scored(make(*docs), quality.train(make(*docs), labels)).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 40 and all((r["score"] >= 0.3) == (r["doc_id"] % 2 == 0) for r in held)
