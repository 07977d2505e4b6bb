import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources.spec import DIALECTS
from tessera.streaming import records as streaming
from tests import scalar
from tests.test_formats import ALPHABETS, texts


@pytest.mark.parametrize("name", ["csv", "ndjson", "logfmt", "csv_hash"])
def test_any_cuts_give_the_same_records(name):
    dialect, rng = DIALECTS[name], random.Random(1)
    for text in texts(ALPHABETS[name], 300, name):
        got, rest, at = [], "", 0
        while at < len(text):
            step = rng.randint(1, 9)
            more, rest = streaming.cut(rest + text[at : at + step], dialect, False)
            got, at = got + more, at + step
        got += streaming.cut(rest, dialect, True)[0]
        assert got == scalar.raws(text, dialect), repr(text)


def test_stream_equals_batch(spark):
    rows = [(f"s{i}", f'{i},"a\nb"\r\nlast {i}') for i in range(7)]
    chunks = streaming.sequenced(spark.createDataFrame(rows, "stream string, text string"), 3)
    got = {(r["stream"], r["rec_no"]): r["raw"] for r in streaming.replayed(chunks, DIALECTS["csv"]).collect()}
    assert got == {(s, k): v for s, t in rows for k, v in enumerate([t.split("\r\n")[0], t.split("\r\n")[1]])}


class _Held:
    """The state of one bucket between micro-batches."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


@pytest.mark.parametrize("name", ["csv", "fastq"])
def test_one_call_folds_many_streams(name):
    """Streams that open, wait and end in different micro-batches of one bucket."""
    calls, take = [], (lambda t, _: streaming.cut_groups(t, 4)) if name == "fastq" else (lambda t, final: streaming.cut(t, DIALECTS[name], final))
    run = streaming._fold(take, "x")
    texts = {f"s{i}" if i else None: f'"{i}\n",b\r\n\nlast\n{"y" * (i % 3)}' for i in range(3000)}
    chunks = [(s, q, t[4 * q : 4 * q + 4] or None, 4 * q + 4 >= len(t)) for s, t in texts.items() for q in range(max(1, -(-len(t) // 4)))]
    random.Random(2).shuffle(chunks)
    held, got = _Held(), {}
    for q in range(0, 9, 2):
        part = pd.DataFrame([c for c in chunks if c[1] in (q, q + 1)], columns=["stream", "seq", "chunk", "eof"])
        calls += [frame for frame in run((0,), iter([part[:50], part[50:]]), held)] if len(part) else []
    for frame in calls:
        got |= {(r.stream, r.rec_no): r.x for r in frame.itertuples()}
    whole = {s: take(t, True)[0] for s, t in texts.items()}
    assert got == {(s, n): x for s, found in whole.items() for n, x in enumerate(found)}
    assert len(calls) < 9 and not held.exists


def test_the_registered_replay_takes_all_orders(spark, tmp_path):
    rows = [(i, "FOP"[i % 3], f"{i}-LOW") for i in range(20)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r["stream"], r["rec_no"]): r["raw"] for r in registry.stream_equals_batch(spark, str(tmp_path)).collect()}
    assert got == {(str(k), n): raw for k, s, p in rows for n, raw in enumerate([f'"a\n""b",{s}', p])}


@pytest.mark.parametrize("step", [1, 3, 50])
def test_any_cuts_give_the_same_groups(step):
    for text in ("", "a", "a\nb\nc\nd", "a\nb\r\n\nd\ne\n", "1\n2\n3\n4\n5\n6\n7\n8\n", "\n" * 9):
        got, rest = [], ""
        for at in range(0, len(text), step):
            more, rest = streaming.cut_groups(rest + text[at : at + step], 4)
            got += more
        lines = [x.removesuffix("\r") for x in text.split("\n")[:-1]]
        assert got == [lines[k : k + 4] for k in range(0, len(lines) - 3, 4)]


def test_the_registered_groups_drop_the_cut_off_ones(spark, tmp_path):
    rows = [(i, "FOP"[i % 3], f"{i}-LOW") for i in range(12)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r["stream"], r["rec_no"]): (r["name"], r["bases"]) for r in registry.stream_grouped_lines(spark, str(tmp_path)).collect()}
    want = {(str(k), 0): (s, len(p)) for k, s, p in rows} | {(str(k), 1): ("last", 0) for k, s, _ in rows if s == "F"}
    assert got == want


def test_a_table_of_one_row_group_is_cut_by_many_tasks(spark, tmp_path):
    rows = [(str(i), f"@{i}\n" * (i % 5) + "é", i) for i in range(200)] + [("null", None, 0), ("", "", 0)]
    spark.createDataFrame(rows, "k string, t string, n int").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = streaming.sequenced(spark.read.parquet(str(tmp_path / "t")), 3, "k", "t").withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 1
    want = {(k, q, t and t[3 * q : 3 * q + 3], 3 * q + 3 >= len(t or "")) for k, t, _ in rows for q in range(max(1, -(-len(t or "") // 3)))}
    assert len(got) == len(want) and {(r["stream"], r["seq"], r["chunk"], r["eof"]) for r in got} == want


def test_neighbours_of_a_stream_cross_as_one_row():
    rows = [("a", 0, "é\n", False), ("a", 1, None, False), ("a", 2, "x", True), ("a", 4, "y", None), ("b", 5, "", False), ("b", 5, "z", True), (None, 0, "p", False), (None, 1, "q", True)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("stream", "seq", "chunk", "eof"), r, strict=True)) for r in rows])
    want = [("a", 0, "é\nx", True), ("a", 4, "y", False), ("b", 5, "", False), ("b", 5, "z", True), (None, 0, "p", False), (None, 1, "q", True)]
    for cut, expected in ((batch, want), (batch.slice(1), [("a", 1, "x", True), *want[1:]]), (batch.slice(0, 2), [("a", 0, "é\n", False)])):
        (got,) = streaming._joined(iter([cut]))
        assert [tuple(r.values()) for r in got.to_pylist()] == expected and got.schema.names == batch.schema.names
    assert list(streaming._joined(iter([batch.slice(0, 0)]))) == []


@pytest.mark.parametrize("size", [1, 4000])
def test_records_leave_in_rows_of_bounded_size(size):
    texts = {f"s{i}": "a\r\n\nb\n" + "y" * size + "\n" + "rest" for i in range(50)}
    run = streaming._fold(lambda t, _: streaming.raw_groups(t, 2), "raw", True)
    (got,) = run((0,), iter([pd.DataFrame([(s, 0, t, True) for s, t in texts.items()], columns=["stream", "seq", "chunk", "eof"])]), _Held())
    flat = [x for r in got.itertuples() for x in zip(r.stream, r.rec_no, r.raw, strict=True)]
    assert flat == [(s, n, x) for s in texts for n, x in enumerate(["a\n", "b\n" + "y" * size])]
    assert len(got) == (5 if size == 1 else 100)
