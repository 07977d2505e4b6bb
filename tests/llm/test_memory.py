"""What Python workers keep while they wait beside later stages."""

from pathlib import Path

import numpy as np
import pyarrow as pa

from tessera.llm import bpe, quality, textbytes as tb


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_freed_memory_leaves_the_process():
    pins, before = [], _resident()

    def run(batches):
        parts = [np.ones(8000) for _ in range(3000)]
        pins.append(np.ones(8000))
        del parts
        yield from batches

    assert list(tb.lean(run)(iter([1, 2]))) == [1, 2]
    assert _resident() - before < 64e6


def test_stages_of_others_drop_the_encoder():
    bpe.encoder(*bpe.vocabulary())
    assert tb.kept("bpe")
    list(tb.lean(lambda batches: batches, "bpe")(iter([])))
    assert tb.kept("bpe")
    list(tb.lean(lambda batches: batches)(iter([])))
    assert not tb.kept("bpe")


def test_groups_drop_the_encoder():
    bpe.encoder(*bpe.vocabulary())
    block = pa.table({"x": [1]})
    assert tb.lean_group(lambda x: x)(block) is block and not tb.kept("bpe")


def test_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, rows in (("10000", "1000"), ("0", "1000"), ("-1", "1000"), ("50", "50")):
            spark.conf.set(key, given)
            quality.scored(spark.createDataFrame([], "doc_id bigint, text string"), quality.constant_model())
            assert spark.conf.get(key) == rows
    finally:
        spark.conf.set(key, before)
