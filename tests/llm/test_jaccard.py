import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, jaccard


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def plain(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(docs))


def corpus(rng, bases, copies, length):
    words = [f"w{i}" for i in range(400)]
    docs = []
    shared = " ".join(rng.choice(words) for _ in range(15))
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w) + (" " + shared if rng.random() < 0.5 else ""))
    return docs


@pytest.mark.parametrize("width,percent,copies,sizes", [(4, 85, 6, (256, 512)), (5, 80, 40, (4, 3)), (4, 50, 10, (8, 2))])
def test_against_brute_force(make, monkeypatch, width, percent, copies, sizes):
    monkeypatch.setattr(jaccard, "GROUP_SETS", sizes[0])
    monkeypatch.setattr(jaccard, "BLOCK_QUERIES", sizes[1])
    monkeypatch.setattr(jaccard, "SEEN", 2)
    rng = random.Random(percent)
    texts = corpus(rng, 14, copies, 120) + ["", None, " ", "one", "One", "ONE two", "one two three", "one two three"]
    docs = [(rng.randrange(10**9), t) for t in texts]
    got = jaccard.jaccard_classes(make(*docs).withColumn("s", F.lit(0)).withColumn("n", F.lit(0)), width, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == plain(docs, width, percent)


def test_stage_keeps_one_of_each_class(make):
    docs = make((5, "a b c d e f"), (3, "A B C D E F"), (9, "x"), (8, ""), (7, None), (9, "x"), (None, "q r"))
    kept = jaccard.keep_one(docs, 5, 80).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "q r"), (3, "A B C D E F"), (7, ""), (8, ""), (9, "x")]
    assert jaccard.keep_one(docs.limit(0), 5, 80).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 204), (204, 203)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 203: 203, 204: 203, 205: 203}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_at_the_threshold_in_groups_of_mixed_sizes(make, monkeypatch):
    """41 words against 46, 40 of them shared but one in the prefixes; 45 and 47 in the group would ask for two."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    texts = []
    for r in range(10):
        own = lambda name, n: [f"{name}{r}x{i}" for i in range(n)]  # noqa: B023, E731
        s, z = own("s", 40), own("z", 39)
        texts += [s + own("q", 1), s + own("b", 6), s[:1] + z[:38] + own("c", 6), s[:1] + z + own("d", 7)]
        texts += [s[1:] + z + own(f"fill{k}", 60) for k in range(4)]  # makes all but the first shared word common
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = jaccard.jaccard_classes(make(*docs), 1, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain(docs, 1, 85)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_a_group_is_opened_if_one_of_its_sizes_can_link(spark, percent):
    ceil = lambda x, y: -(-x // y)
    rows = []
    for n in (*range(1, 60, 2), 200, 201, 333):
        first, last = ceil(percent * n, 100), 100 * n // percent
        for low in range(max(first - 1, 1), last + 1, 1 + n // 20):
            for high in {low, low + 1, low + 2, low + n // 20, last + 1}:
                sizes = range(max(low, first), min(high, last) + 1)
                if sizes:
                    needs = [ceil(percent * (n + m), 100 + percent) - max(first, ceil(percent * m, 100)) + 1 for m in sizes]
                    rows += [(o, n, low, high, o >= min(needs)) for o in (min(needs) - 1, min(needs))]
    given = spark.createDataFrame(rows, "overlap bigint, n bigint, low bigint, high bigint, want boolean")
    wrong = given.filter(F.col("want") != F.expr(jaccard._opens("overlap", "n", "low", "high", percent)))
    assert wrong.count() == 0
