import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp

WORDS = " ".join(f"w{i % 37}x{i % 11}" for i in range(900))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_sketch_is_a_sample_of_all_shingle_hashes(spark, make):
    docs = make(WORDS, WORDS.upper(), None, "", "one", "a b\tc\nd", " a b  c d ", "a b c d e f")
    found = {r["doc_id"]: r for r in docs.select("doc_id", fp.sketch(F.col("text")).alias("s"), fp.shingle_hashes(fp.split_words(F.col("text"))).alias("h")).collect()}
    for k, text in enumerate(r["text"] for r in docs.orderBy("doc_id").collect()):
        hashes = set(found[k]["h"])
        assert len(hashes) == len(shingles(text))
        low = sorted(h for h in hashes if h < (1 << 63) // fp.SCALE)
        assert found[k]["s"] == (low or sorted(hashes)[:1])
    assert found[5]["s"] == found[6]["s"] and found[2]["s"] == []


def test_measures(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [3, 4]), ([], []), ([], [1])], "a array<bigint>, b array<bigint>")
    got = [tuple(r) for r in rows.select(fp.likeness(F.col("a"), F.col("b")), fp.containment(F.col("b"), F.col("a")), fp.merge(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5, 1.0, [1, 2, 3, 4]), (1.0, 1.0, []), (0.0, 0.0, [1])]


def test_next_document(spark, make, tmp_path):
    texts = {3: "abcdefgh" * 4, 10: None, 12: "é🙂xyz123", 40: "ab", 7: WORDS}
    docs = make(*texts.items())
    docs.withColumn("text_", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.op1_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(texts)
    for i, k in enumerate(order):
        text, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[k]["n_chars"] == len(text)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1


def test_one_document_ties_and_no_documents(spark, make, tmp_path):
    for name, docs in (("one", make("a b c d e f")), ("none", make()), ("same", make((1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, "d")))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    one = fp.op1_fingerprints(spark, str(tmp_path / "one")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fp.op1_fingerprints(spark, str(tmp_path / "none")).count() == 0
    same = fp.op1_fingerprints(spark, str(tmp_path / "same")).collect()
    assert sorted((r["doc_id"] or 0) for r in same) == [0, 1, 1, 1, 2]


def test_a_hash_that_is_no_sample_stays_out_of_comparisons(spark):
    high = (1 << 63) // fp.SCALE
    rows = spark.createDataFrame([([high + 5], [1, 2]), ([1, 2], [high + 5]), ([high + 5], [high + 5]), ([high + 7], [high + 5]), ([], [high + 5])], "a array<bigint>, b array<bigint>")
    got = [tuple(r) for r in rows.select(fp.likeness(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.merge(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.0, None, [1, 2]), (0.0, 0.0, [1, 2]), (1.0, 1.0, [high + 5]), (0.0, 0.0, [high + 5]), (0.0, 1.0, [high + 5])]


def test_merged_sketches_of_short_texts_are_the_sketch_of_all_shingles(spark):
    # one word is one shingle; in 40 of them some lie above the threshold and some below
    rows = spark.createDataFrame([(f"w{i}", f"v{i}") for i in range(40)], "x string, y string")
    first = rows.select(fp.sketch(F.col("x")).alias("a"), fp.sketch(F.col("y")).alias("b")).withColumn("m", fp.merge(F.col("a"), F.col("b"))).collect()
    for r in first:
        every = sorted({*r["a"], *r["b"]})
        assert r["m"] == ([h for h in every if h < (1 << 63) // fp.SCALE] or every[:1])


def test_estimates_come_near_the_shares_of_all_shingles(spark, make, tmp_path):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    # a very long text, a part of it, one that half overlaps that part, another text
    texts = [" ".join(words), " ".join(words[4000:6000]), " ".join(words[5000:7000]), " ".join(f"v{k}" for k in range(3000))]
    make(*texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.op1_fingerprints(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        q = len(text) // 4
        for other, near, held in ((text[: len(text) - q] + after[:q], "near_edited", "contained_in_edited"), (after, "near_next", "contained_in_next")):
            a, b = shingles(text), shingles(other)
            assert abs(got[k][near] - len(a & b) / len(a | b)) < 0.08
            assert abs(got[k][held] - len(a & b) / len(a)) < 0.08
    # the part is held whole, though the texts are very unequal
    pair = spark.createDataFrame([(texts[1], texts[0])], "a string, b string")
    assert pair.select(fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).first()[0] == 1.0
