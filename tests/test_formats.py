import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.operators import columns, nested, records, stats
from tessera.plans import registry
from tessera.sources.spec import DIALECTS, SPECS, Column, with_columns
from tests import scalar

ALPHABETS = {
    "csv": ',\n\r"" xy', "csv_hash": 'abc,,\n\n""##  ,\nx"', "logfmt": '\\\\" =\nxy', "ndjson": '\\"\n{}x', "tsv": "\t\nxy\r", "multi": ',;|\t: /=&\n""x', "vcf": "\t\n#xy", "lines": "\nx\r",
}


def texts(alphabet, n, seed, longest=60):
    rng = random.Random(seed)
    return ["", "\n", alphabet] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("name", ALPHABETS)
def test_records_and_fields_match_a_plain_reading(spark, name):
    dialect, given = DIALECTS[name], texts(ALPHABETS[name], 400, name)
    docs = spark.createDataFrame(list(enumerate(given)), "k int, doc string")
    rows = records.with_fields(records.records(docs, "doc", dialect, ["k"]), dialect)
    got = {}
    for r in rows.select("k", "rec_no", "fields", F.transform("fields", lambda x: cells.clean(x, dialect)).alias("cleaned")).collect():
        got.setdefault(r["k"], {})[r["rec_no"]] = (r["fields"], r["cleaned"])
    for k, text in enumerate(given):
        want = scalar.records(text, dialect)
        mine = [got.get(k, {})[i] for i in range(len(got.get(k, {})))]
        assert [m[0] for m in mine] == want, repr(text)
        assert [m[1] for m in mine] == [[scalar.clean(x, dialect) for x in r] for r in want]


def test_texts_that_hold_the_marks_are_split_the_same(spark):
    given = ['a\u0001b,"c\u0002,\u0003",\u0004d', '\u0004a,"\u0001,"', 'k="\u0001 \\"\u0002" \u0003=1']
    docs = spark.createDataFrame(list(enumerate(given)), "k int, raw string")
    for dialect in (DIALECTS["csv"], DIALECTS["logfmt"]):
        for r in records.with_fields(docs, dialect).collect():
            assert r["fields"] == scalar.records(given[r["k"]], dialect)[0]


@pytest.mark.parametrize("parts", [1, 2, 3, 8, 16])
def test_partitions_do_not_matter(spark, parts):
    docs = spark.createDataFrame(list(enumerate(texts(ALPHABETS["csv_hash"], 50, 5))), "k int, doc string")
    rows = lambda d: sorted(map(tuple, records.records(d, "doc", DIALECTS["csv_hash"], ["k"]).collect()))
    assert rows(docs.repartition(parts)) == rows(docs.coalesce(1))


@pytest.mark.parametrize("name", ["csv", "logfmt", "tsv", "vcf"])
def test_files_cut_into_blocks_read_as_one_document(spark, tmp_path, name):
    dialect, rng = DIALECTS[name], random.Random(3)
    text = "".join(rng.choice(ALPHABETS[name]) for _ in range(4000))
    (tmp_path / "one.txt").write_bytes(text.encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [r["raw"] for r in records.file_records(spark, str(tmp_path / "one.txt"), dialect).orderBy("rec_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    docs = spark.createDataFrame([(text,)], "doc string")
    assert got == [r["raw"] for r in records.records(docs, "doc", dialect).orderBy("rec_no").collect()]


def test_terminated_count(spark):
    given = texts(ALPHABETS["csv_hash"], 200, 9)
    docs = spark.createDataFrame(list(enumerate(given)), "k int, doc string")
    dialect = DIALECTS["csv_hash"]
    for r in docs.select("k", records.terminated_count(F.col("doc"), dialect).alias("n")).collect():
        text = given[r["k"]]
        assert r["n"] == sum(text[i] == "\n" for i in scalar.structurals(text, dialect)), repr(text)


def test_grouped_lines_drop_partial_groups(spark):
    docs = spark.createDataFrame([(0, "@a\nAC\n+\n!!\n@b\nT"), (1, "a\nb\nc\nd"), (2, ""), (3, "\n\n\n\n")], "k int, doc string")
    got = sorted((r["k"], r["rec_no"], r["fields"]) for r in records.grouped_lines(docs, "doc", DIALECTS["fastq"], ["k"]).collect())
    assert got == [(0, 0, ["@a", "AC", "+", "!!"]), (3, 0, ["", "", "", ""])]


def test_null_rules(spark):
    spec = with_columns("csv", Column(0, "i64", "a"), Column(1, "string", "s"), Column(2, "bytes", "b"), Column(3, "f64", "f"))
    docs = spark.createDataFrame([('1,"x ""y""",raw,2.5\n"7",,,\nbad\n\n',)], "doc string")
    got = [tuple(r) for r in columns.parse_columns(docs, "doc", spec).collect()]
    assert got == [(1, 'x "y"', bytearray(b"raw"), 2.5), (7, "", None, None), (None, None, None, None), (None, None, None, None)]


def test_comment_example(spark):
    doc = '# header comment, with "quotes" and, commas\nfoo,42\n#mid, comment\nbar,7\n"#not,a comment",9\n# trailing'
    got = columns.parse_columns(spark.createDataFrame([(doc,)], "doc string"), "doc", SPECS["csv_hash"])
    assert [tuple(r) for r in got.collect()] == [("foo", 42), ("bar", 7), ("#not,a comment", 9)]


def test_numbers(spark):
    given = ["inf", "-inf", "NaN", "-nan", "+Infinity", "infinit", "1e400", "5e-324"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x string").select(cells.cast_f64(F.col("x"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == math.inf and got[5] is None
    assert got[6] == math.inf and got[7] == 5e-324


def test_info_values(spark):
    given = {"DP=1;DP=2": "2", "DP=1;DP": None, "XDP=3": None, "": None, "AF=1;DP=": "", "DP=a=b": "a=b"}
    rows = spark.createDataFrame([(x,) for x in given], "x string").select("x", cells.info_value(F.col("x"), "DP").alias("v"))
    assert {r["x"]: r["v"] for r in rows.collect()} == given


def test_bits_and_byte_sums(spark):
    import struct

    given = [0.0, -0.0, 1.5, -2.25, math.inf, 1e-310]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", cells.double_bits(F.col("x")).alias("d"), cells.float_bits(F.col("x")).alias("f"))
    for r in rows.collect():
        assert int(r["d"]) == struct.unpack("<Q", struct.pack("<d", r["x"]))[0]
        assert r["f"] == struct.unpack("<I", struct.pack("<f", r["x"]))[0]
    content = [b"", b"\x00", b"\xff\x10abc", bytes(range(256))]
    got = spark.createDataFrame([(bytearray(x),) for x in content], "x binary").select(cells.byte_sum(F.col("x"))).collect()
    assert [r[0] for r in got] == [sum(x) for x in content]


def test_wrapping_sum(spark):
    rows = spark.createDataFrame([(str((1 << 64) - 1),), ("5",)], "x string").select(F.col("x").cast("decimal(20,0)").alias("x"))
    assert int(rows.agg(cells.wrapped(F.sum("x"))).first()[0]) == 4


def test_logfmt_pairs_ignore_which_separator(spark):
    rows = records.with_fields(spark.createDataFrame([('a b=c',), ('m="x \\" y" k',), ("r=a\\b",)], "raw string"), DIALECTS["logfmt"])
    got = {(r["key"], r["value"]) for r in stats.logfmt_rows(rows, DIALECTS["logfmt"], []).collect()}
    assert got == {("a", "b"), ("m", 'x " y'), ("r", "a\\b")}


def test_ndjson_sum_raises_on_a_missing_path(spark):
    rows = spark.createDataFrame([('{"id": 1}',)], "line string")
    with pytest.raises(Exception, match="lacks one of the paths"):
        stats.ndjson_sum(rows, "line", ["$.id", "$.nested.score"]).collect()


@pytest.mark.parametrize("seed", range(2))
def test_nesting_matches_a_plain_reading(spark, seed):
    dialect, given = DIALECTS["json"], texts('{}[],:"\\ x1', 250, f"n{seed}", 24)
    given = list(dict.fromkeys(given))
    docs = spark.createDataFrame(list(enumerate(given)), "k int, doc string")
    found = {r["k"]: (r["error"], r["pos"]) for r in nested.errors(docs, "doc", dialect, "k").collect()}
    pairs = {}
    for r in nested.tape(docs, "doc", dialect, "k").filter("turn <> 0 and partner is not null").collect():
        pairs.setdefault(r["k"], {})[r["pos"]] = r["partner"]
    words = {r["k"]: r["s"] for r in docs.select("k", nested.scalars(F.col("doc"), dialect).alias("s")).collect()}
    for k, text in enumerate(given):
        want, error, pos = scalar.nesting(text, dialect)
        assert found[k] == (error, pos), repr(text)
        if not error:
            assert pairs.get(k, {}) == want, repr(text)
        assert words[k] == scalar.scalars(text, dialect)


def test_registered_lines_take_whole_texts(spark, tmp_path):
    given = ["a\r\nb\n", "", None, "x\r", "\n", "last", "a\rb", "\r\n\r\n", "é\n\nz"]
    spark.createDataFrame([(t,) for t in given], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = []
    for text in given:
        parts = (text or "").split("\n")
        lines += [p.removesuffix("\r") for p in (parts if parts[-1] else parts[:-1])]
    got = registry.lines_documents(spark, str(tmp_path)).first()
    assert (got["records"], got["bytes"]) == (len(lines), sum(len(x.encode()) for x in lines))


def files_in_blocks(spark, path, dialect, size=97):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return [r["raw"] for r in records.file_records(spark, str(path), dialect).orderBy("rec_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(3))
def test_comments_and_quotes_in_blocks_read_as_one_document(spark, tmp_path, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(['é,"', "#", '"', "\n", "\n#", "x\n", 'a"b', '#"\n']) for _ in range(2500))
    (tmp_path / "one.txt").write_text(text, encoding="utf-8")
    got = files_in_blocks(spark, tmp_path / "one.txt", DIALECTS["csv_hash"])
    assert got == scalar.raws(text, DIALECTS["csv_hash"]) and len(got) > 50


def test_lines_of_files_are_numbered_without_assembly(spark, tmp_path):
    rng = random.Random(1)
    for name in "ab":
        (tmp_path / name).write_text("".join(rng.choice(["#c\n", "é\tx\n", "\n", "long line " * 9 + "\r\n"]) for _ in range(80)), encoding="utf-8")
        text = (tmp_path / name).read_bytes().decode()
        for dialect in ("vcf", "tsv"):
            assert files_in_blocks(spark, tmp_path / name, DIALECTS[dialect]) == scalar.raws(text, DIALECTS[dialect])


def test_long_documents_with_comments(spark):
    doc = '# one "\n' + "".join(f'{i}\n#x"\n"a\n#{i}",2\n' for i in range(40_000))
    got = spark.createDataFrame([(doc,)], "doc string").select(records.document_records(F.col("doc"), DIALECTS["csv_hash"]).alias("r")).first()["r"]
    assert got == [x for i in range(40_000) for x in (str(i), f'"a\n#{i}",2')]


@pytest.mark.parametrize("name", ["csv_hash", "vcf", "csv", "logfmt"])
def test_structural_index_matches_a_plain_reading(spark, name):
    dialect, given = DIALECTS[name], ['# x "y,\na,b\n', *texts(ALPHABETS[name], 200, name)]
    docs = spark.createDataFrame(list(enumerate(given)), "k int, doc string")
    got = {}
    for r in nested.structural_index(docs, "doc", dialect, "k").orderBy("k", "tape_idx").collect():
        got.setdefault(r["k"], []).append(r["pos"])
    for k, text in enumerate(given):
        assert got.get(k, []) == scalar.structurals(text, dialect), repr(text)


def test_vcf_and_geo_checksums_match_plain_sums(spark):
    import struct

    rows = [("c\t5\ti\tAC\tGé\t2.5", 5, 2.5), ("c\t-1\ti\tA\t\tx", -1, None), ("c\tz\ti\tA\tT\t1e300", None, 1e300), ("c\t7", 7, None)]
    given = records.with_fields(spark.createDataFrame([(r,) for r, _, _ in rows], "raw string"), DIALECTS["vcf"])
    f = F.col("fields")
    got = stats.vcf_stats(given, [cells.cast_i64(F.get(f, F.lit(1))), cells.cast_f64(F.get(f, F.lit(5)))]).first()
    alleles = [b"".join(x.encode() for x in r.split("\t")[3:5]) for r, _, _ in rows]
    single = lambda x: struct.pack("<f", x) if abs(x) < 3e38 else struct.pack("<f", math.inf)
    want = sum(map(sum, alleles)) + sum(sum(struct.pack("<q", p)) for _, p, _ in rows if p is not None) + sum(sum(single(q)) for _, _, q in rows if q is not None)
    assert (got["records"], got["primary_bytes"], got["pos_values"], int(got["checksum"])) == (4, sum(map(len, alleles)), 3, want)
    places = [(1.5, -0.0), (None, 2.25), (-1e-300, math.inf)]
    got = stats.geo_stats(spark.createDataFrame(places, "latitude double, longitude double")).first()
    bits = lambda xs: sum(struct.unpack("<Q", struct.pack("<d", x))[0] for x in xs if x is not None) % (1 << 64)
    assert (got["records"], got["latitude_values"], got["longitude_values"]) == (3, 2, 3)
    assert (int(got["latitude_checksum"]), int(got["longitude_checksum"])) == (bits([a for a, _ in places]), bits([b for _, b in places]))
