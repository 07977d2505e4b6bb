import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks, pattern = bpe.vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


TEXTS = ["", " ", "a" * 3000, "ab" * 900, "!" * 700, " " * 600, "　  x", "it's I'LL we'd", "汉字🙂é" * 60, "x́y 12 3４½", "\x00\x1c\x85\xa0 z", "<|endoftext|>"]


def test_ids_are_those_of_the_library(both):
    mine, theirs = both
    rng = random.Random(4)
    alphabet = "abcdefgh ABC\n\t'sé ñ1234!?|€汉字🙂 "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(500)]
    for t, ids in zip(texts, mine.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), repr(t[:60])
        assert mine.decode(ids) == t.encode() and mine.encode(t) == ids


def test_small_caches_and_matrices_change_nothing(both, monkeypatch):
    mine, _ = both
    want = mine.encode_batch(TEXTS)
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "CELLS", 8)
    monkeypatch.setattr(bpe, "LONG", 20)
    mine.cache.clear()
    assert mine.encode_batch(TEXTS) == want


def test_unknown_ids_raise(both):
    with pytest.raises(KeyError):
        both[0].decode(np.array([60_000], "<u4").tobytes())


def test_operator(make, both):
    texts = [*TEXTS, None, "same", "same"]
    docs = make(*texts).withColumn("ids", F.lit(1)).withColumn("_text", F.lit(2))
    got = {r["doc_id"]: r for r in bpe.encoded(docs, *bpe.vocabulary()).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = np.array(both[1].encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[k]["ids"]) == ids and got[k]["n_tokens"] == len(ids) // 4
        assert got[k]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), *bpe.vocabulary()).count() == 0
