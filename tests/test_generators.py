import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import columns, records
from tessera.sources.generators import FORMATS, generated
from tessera.sources.spec import DIALECTS, SPECS
from tests import scalar

ROWS = 400


def raws(spark, name, seed=0, partitions=3):
    return [r["raw"] for r in generated(spark, name, ROWS, seed, partitions).orderBy("row").collect()]


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_rows_depend_on_their_number_and_the_seed_alone(spark, name):
    first = raws(spark, name)
    assert first == raws(spark, name, partitions=7) != raws(spark, name, seed=1)
    assert len(first) == ROWS and len(set(first)) == ROWS


@pytest.mark.parametrize("name, fields", [("csv", 8), ("csv_hash", 8), ("csv_geo", 7), ("tsv", 8), ("vcf", 8)])
def test_delimited_formats_have_their_fields(spark, name, fields):
    dialect = DIALECTS.get(name, DIALECTS["csv"])
    text = "\n".join(raws(spark, name)) + "\n"
    got = scalar.records(text, dialect)
    assert {len(r) for r in got} == {fields}
    assert len(got) == (ROWS - 8 - ROWS // 50 + 1 if name == "csv_hash" else ROWS)
    docs = spark.createDataFrame([(text,)], "doc string")
    assert [r["raw"] for r in records.records(docs, "doc", dialect).orderBy("rec_no").collect()] == scalar.raws(text, dialect)


def test_hard_cells_occur(spark):
    text = "\n".join(raws(spark, "csv"))
    assert 'q""q"' in text and "x\ny" in text and 'a,b"' in text
    assert any(r.startswith("# ") for r in raws(spark, "csv_hash"))


def test_values_can_be_read(spark):
    for r in raws(spark, "ndjson"):
        got = json.loads(r)
        assert [len(got["tags"]), type(got["id"]), type(got["nested"]["score"]), type(got["nested"]["ok"])] == [2, int, int, bool]
    geo = columns.typed(spark.createDataFrame([(r,) for r in raws(spark, "csv_geo")], "raw string"), SPECS["csv_geo"])
    assert geo.filter("latitude between -90 and 90 and longitude between -180 and 180").count() == ROWS - 1
    assert all(r.startswith("ts=") and " dur=" in r for r in raws(spark, "logfmt"))


def test_reads_are_valid(spark):
    docs = spark.createDataFrame([("\n".join(raws(spark, "fastq")) + "\n",)], "doc string")
    rows = records.grouped_lines(docs, "doc", DIALECTS["fastq"])
    assert rows.count() == ROWS
    size = F.length(F.get("fields", F.lit(1)))
    assert rows.filter((size == F.length(F.get("fields", F.lit(3)))) & size.between(80, 159)).count() == ROWS
