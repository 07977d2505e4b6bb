import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources import datasource, framing
from tessera.sources.framing import BGZF, Framing, FramingError, SizeField, read_varint, scan, scan_bgzf, write_bgzf


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def test_varint_frames_tile_the_input():
    sizes = [0, 1, 5, 127, 128, 300]
    data = b"".join(varint(n) + b"x" * n for n in sizes)
    got = list(scan(Framing(0, width="varint"), data))
    assert [f.payload_end - f.payload_start for f in got] == sizes and sum(f.len for f in got) == len(data)
    assert len(list(scan(Framing(0, width="varint", skip_empty=True), data))) == 5


@pytest.mark.parametrize("data", [b"\x80", b"\x80" * 10 + b"\x01", b"\xff" * 9 + b"\x7f"])
def test_bad_varints(data):
    with pytest.raises(FramingError):
        read_varint(data, 0)


def test_errors():
    with pytest.raises(FramingError):
        list(scan(Framing(4), b"\x05\0\0\0abc"))
    with pytest.raises(FramingError):
        list(scan(Framing(2, 1, 2), b""))
    with pytest.raises(FramingError):
        list(scan(Framing(4, magic=(0, b"Z")), b"\x00\0\0\0"))
    with pytest.raises(FramingError):
        list(scan(Framing(4, counts="total"), b"\x01\0\0\0"))
    with pytest.raises(FramingError):
        list(scan_bgzf(b"not gzip at all"))


def test_both_readings_of_blocks_agree():
    data = write_bgzf(b"hello\n" * 5000, 777)
    canonical = [f for f in scan(BGZF, data) if f.uncompressed]
    assert canonical == list(scan_bgzf(data))


@pytest.mark.parametrize("block", [37, 512, 4096])
def test_straddling_records(spark, block):
    rng = random.Random(block)
    text = "".join(f"{i},{'v' * rng.randint(0, 40)}\n" for i in range(600)) + "tail"
    files = spark.createDataFrame([("a", bytearray(write_bgzf(text.encode(), block))), ("b", bytearray(write_bgzf(b"", block)))], "path string, content binary")
    rows = framing.stitched_records(framing.decoded(framing.frames(files, "bgzf").repartition(5), check_sizes=True))
    assert [r["raw"] for r in rows.orderBy("rec_no").collect()] == text.split("\n")


def test_stated_sizes_are_checked(spark):
    files = spark.createDataFrame([("a", bytearray(b"\x03\x09abc"))], "path string, content binary")
    rows = framing.frames(files, Framing(2, width=1, uncompressed=SizeField(1, 1)))
    with pytest.raises(Exception, match="states 9 bytes"):
        framing.decoded(rows, "none", check_sizes=True).collect()


def test_data_source(spark, tmp_path):
    text = "".join(f"{i}\n" for i in range(3000))
    path = tmp_path / "x.gz"
    path.write_bytes(write_bgzf(text.encode(), 500))
    spark.dataSource.register(datasource.FramedSource)
    rows = spark.read.format("framed").option("framing", "bgzf").option("framesPerPartition", 4).load(str(path))
    assert rows.rdd.getNumPartitions() > 3
    got = framing.stitched_records(rows).orderBy("rec_no")
    assert [r["raw"] for r in got.collect()] == text.split("\n")[:-1]
    assert spark.read.text(str(path)).count() == 3000
    assert framing.read_bgzf_records(spark, str(path)).agg(F.count("*")).first()[0] == 3000


def test_registered_documents_have_several_blocks(spark, tmp_path):
    text = "\n".join(f"line {i} of a document" for i in range(70))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = registry._bgzf(spark, str(tmp_path))
    assert 1400 < len(text) < 2100 and framing.frames(files, "bgzf", key="doc_id").count() >= 3
    assert [(r["records"], r["bytes"]) for r in registry.bgzf_records(spark, str(tmp_path)).collect()] == [(70, len(text) - 69)]


@pytest.mark.parametrize("terminator", ["|", ".", "\n"])
def test_any_terminator_and_any_bytes(spark, terminator):
    parts = [b"x1", "é€🙂".encode(), b"z333", b"", b"\xff\xfe", b"last"]
    content = terminator.encode().join(parts)
    rows = [("k", n, bytearray(content[i : i + 5])) for n, i in enumerate(range(0, len(content), 5))]
    got = framing.stitched_records(spark.createDataFrame(rows, "path string, frame_no bigint, payload binary"), terminator=terminator)
    found = {r["rec_no"]: bytes(r["raw"]) for r in got.select("rec_no", F.col("raw").cast("binary").alias("raw")).collect()}
    assert [found[k] for k in range(len(parts))] == parts and len(found) == len(parts)


def test_block_compressed_vcf_keeps_its_bytes(spark, tmp_path):
    text = "##h é\n" + "".join(f"c\t{i}\tid\té{i}\t€\t{i}.5\tP\tDP={i};AF=0.5\n" for i in range(200))
    (tmp_path / "x.vcf.gz").write_bytes(write_bgzf(text.encode(), 41))
    raw = framing.read_bgzf_records(spark, str(tmp_path / "x.vcf.gz")).orderBy("rec_no")
    assert [r["raw"] for r in raw.collect()] == text.splitlines()
    got = framing.read_vcf_gz(spark, str(tmp_path / "x.vcf.gz")).orderBy("pos").collect()
    assert [(r["pos"], r["quality"], r["dp"], r["af"]) for r in got] == [(i, i + 0.5, i, 0.5) for i in range(200)]
