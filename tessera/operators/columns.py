"""Typed columns of records: declared fields only, cleaned and cast.

Null rules: a missing field is null; an empty string field is an empty string; an empty or missing bytes field is
null; a number that does not parse is null. Further fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import cast_f64, cast_i64, clean, info_value, numeric, trim_cr
from tessera.operators.records import records, with_fields
from tessera.sources.spec import Column, Dialect, Spec

_CASTS = {"i64": cast_i64, "f64": cast_f64}


def project(fields: SparkColumn, column: Column, dialect: Dialect) -> SparkColumn:
    cell = F.get(fields, F.lit(column.index))
    if column.info_key is not None:
        out = _CASTS[column.type](info_value(cell, column.info_key))
    elif column.type == "bytes":
        out = F.encode(F.when(cell != "", cell), "UTF-8")
    elif column.type == "string":
        out = clean(cell, dialect)
    else:
        out = numeric(cell, dialect, _CASTS[column.type])
    return out.alias(column.label)


def _needed(spec: Spec) -> int:
    """Fields up to the last that a column reads."""
    return max((c.index for c in spec.columns), default=0) + 1


def typed(rows: DataFrame, spec: Spec, keep: list[str] | None = None, raw: str = "raw") -> DataFrame:
    """Rows of one record each, as typed columns; comment records are left out."""
    if spec.dialect.comment:
        rows = rows.filter(~F.startswith(raw, F.lit(spec.dialect.comment)))
    split = with_fields(rows.withColumn(raw, trim_cr(F.col(raw))), spec.dialect, raw, _needed(spec))
    return split.select(*(keep or []), *[project(F.col("fields"), c, spec.dialect) for c in spec.columns])


def parse_columns(docs: DataFrame, doc: str, spec: Spec, keep: list[str] | None = None) -> DataFrame:
    """Typed columns of every record of documents."""
    rows = records(docs, doc, spec.dialect, keep)
    split = with_fields(rows, spec.dialect, needed=_needed(spec))
    return split.select(*(keep or []), *[project(F.col("fields"), c, spec.dialect) for c in spec.columns])
