"""The registered queries, with DuckDB SQL that computes the same from the original columns.

Each query writes table columns as delimited text, or takes text that a table holds, and has the engine read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.operators import bitstreams, columns, nested, records, stats
from tessera.sources import framing, modules
from tessera.sources.spec import DIALECTS, SPECS, Spec, with_columns
from tessera.sources.spec import Column as Col
from tessera.streaming import records as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

CSV, CSV_HASH, JSON, NDJSON, LOGFMT = (DIALECTS[k] for k in ("csv", "csv_hash", "json", "ndjson", "logfmt"))
LINEITEM = with_columns("csv", Col(0, "i64", "l_orderkey"), Col(1, "i64", "l_linenumber"), Col(2, "f64", "l_quantity"), Col(3, "f64", "l_extendedprice"), Col(4, "f64", "l_discount"), Col(5, "string", "l_returnflag"))


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(sep: str, *cols: str | Column) -> Column:
    """Columns written as one record."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(joined(",", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").alias("raw"))


def _only(spec: Spec, *names: str) -> Spec:
    return Spec(spec.name, spec.dialect, tuple(c for c in spec.columns if c.label in names))


# --- typed columns and fused aggregates


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")
def csv_typed_columns(spark, sf_dir):
    return columns.typed(lineitem_rows(spark, sf_dir), LINEITEM)


@query("SELECT count(*) AS records, sum(l_quantity) AS sum_quantity, round(sum(l_discount), 4) AS sum_discount FROM lineitem")
def csv_fused_agg(spark, sf_dir):
    t = columns.typed(lineitem_rows(spark, sf_dir), _only(LINEITEM, "l_quantity", "l_discount"))
    return t.agg(F.count("*").alias("records"), F.sum("l_quantity").alias("sum_quantity"), F.round(F.sum("l_discount"), 4).alias("sum_discount"))


@query('SELECT count(*) AS count, sum(l_quantity) AS sum FROM lineitem WHERE l_quantity > 25')
def csv_filter_agg(spark, sf_dir):
    return stats.filtered_sum(columns.typed(lineitem_rows(spark, sf_dir), _only(LINEITEM, "l_quantity")), "l_quantity", 25.0)


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS title FROM part")
def csv_quoted_strings(spark, sf_dir):
    title = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    rows = table(spark, sf_dir, "part").select(joined(",", "p_partkey", quoted(title), "p_size").alias("raw"))
    return columns.typed(rows, with_columns("csv", Col(0, "i64", "p_partkey"), Col(1, "string", "title")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS balance, c_custkey % 3 = 2 AND c_custkey % 2 = 0 AS has_segment FROM customer")
def csv_ragged_nulls(spark, sf_dir):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(","), "c_name")).otherwise(
        F.concat(F.lit(","), "c_name", F.lit(","), F.col("c_acctbal").cast("string"), F.lit(","), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit(",more"))
    )
    rows = table(spark, sf_dir, "customer").select(F.concat(k.cast("string"), tail).alias("raw"))
    spec = with_columns("csv", Col(0, "i64", "c_custkey"), Col(1, "string", "name"), Col(2, "f64", "balance"), Col(3, "bytes", "segment"))
    return columns.typed(rows, spec).select("c_custkey", "name", "balance", F.col("segment").isNotNull().alias("has_segment"))


_CELLS = ["9223372036854775807", "-9223372036854775808", "9223372036854775808", "+5", "-0", "0007", "", " 5 ", "1_000", "5d", "0x10", "12a3"]
_FLOATS = ["1.5", "-0.0", ".5", "5.", "1e3", "1.5e308", "+2E-2", "", " 1.5", "1.5d", "1.5f", "0x1p3", "1_0", ".", "e5", "12"]
_GOOD_INTS = "'9223372036854775807', '-9223372036854775808', '+5', '-0', '0007'"
_GOOD_FLOATS = "'1.5', '-0.0', '.5', '5.', '1e3', '1.5e308', '+2E-2', '12'"


def _values(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in texts) + ") v(cell)"


@query(f"SELECT cell, CASE WHEN cell IN ({_GOOD_INTS}) THEN CAST(ltrim(cell, '+') AS BIGINT) END AS value FROM {_values(_CELLS)}")
def i64_cells(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _CELLS], "cell string").select("cell", cells.cast_i64(F.col("cell")).alias("value"))


@query(f"SELECT cell, CASE WHEN cell IN ({_GOOD_FLOATS}) THEN CAST(ltrim(cell, '+') AS DOUBLE) END AS value FROM {_values(_FLOATS)}")
def f64_cells(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _FLOATS], "cell string").select("cell", cells.cast_f64(F.col("cell")).alias("value"))


@query(r"""SELECT 'say \"' || o_orderpriority || '\" \\ ' || o_orderstatus AS written, 'say "' || o_orderpriority || '" \ ' || o_orderstatus AS value FROM orders""")
def escape_backslash(spark, sf_dir):
    plain = F.concat(F.lit('say "'), "o_orderpriority", F.lit('" \\ '), "o_orderstatus")
    written = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rows = table(spark, sf_dir, "orders").select(written.alias("written"), F.concat(F.lit('k="'), written, F.lit('" t=1')).alias("raw"))
    split = records.with_fields(rows, LOGFMT)
    return split.select("written", cells.clean(F.get("fields", F.lit(1)), LOGFMT).alias("value"))


# --- field bytes by dialect


def _field_bytes(spark, sf_dir, name: str, sep: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(joined(sep, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("raw"))
    return stats.field_bytes(records.with_fields(rows, DIALECTS[name]), DIALECTS[name])


_BYTES_SQL = "SELECT count(*) * 4 AS fields, CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) + strlen(c_mktsegment)) AS BIGINT) AS bytes FROM customer"


@query(_BYTES_SQL)
def csv_field_bytes(spark, sf_dir):
    return _field_bytes(spark, sf_dir, "csv", ",")


@query(_BYTES_SQL)
def tsv_field_bytes(spark, sf_dir):
    return _field_bytes(spark, sf_dir, "tsv", "\t")


@query(_BYTES_SQL)
def psv_field_bytes(spark, sf_dir):
    return _field_bytes(spark, sf_dir, "psv", "|")


@query(_BYTES_SQL)
def csv_semicolon_field_bytes(spark, sf_dir):
    return _field_bytes(spark, sf_dir, "csv_semicolon", ";")


@query("SELECT n_nationkey, 10 AS n_fields, n_name AS third, CAST(n_regionkey AS VARCHAR) AS last FROM nation")
def multi_split(spark, sf_dir):
    raw = F.concat(F.col("n_nationkey").cast("string"), F.lit(",a;"), "n_name", F.lit("|b\tc:d e/f=g&"), F.col("n_regionkey").cast("string"))
    rows = records.with_fields(table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw")), DIALECTS["multi"])
    f = F.col("fields")
    return rows.select("n_nationkey", F.size(f).alias("n_fields"), F.get(f, F.lit(2)).alias("third"), F.get(f, F.lit(9)).alias("last"))


# --- records of documents


@query("SELECT doc_id, t.rec_no, CASE WHEN t.rec_no = 0 THEN text ELSE lang END AS value FROM documents, (VALUES (0), (1)) t(rec_no)")
def csv_multiline_records(spark, sf_dir):
    doc = F.concat(quoted(F.coalesce("text", F.lit(""))), F.lit(","), "lang", F.lit("\n"), "lang", F.lit(",x\n"))
    rows = records.records(table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc")), "doc", CSV, ["doc_id"])
    split = records.with_fields(rows, CSV)
    return split.select("doc_id", "rec_no", cells.clean(F.get("fields", F.lit(0)), CSV).alias("value"))


@query("SELECT o_orderkey, '#' || o_orderstatus || chr(10) || o_orderpriority AS key, o_custkey AS amount FROM orders")
def csv_hash_comments(spark, sf_dir):
    key = F.concat(F.lit("#"), "o_orderstatus", F.lit("\n"), "o_orderpriority")
    doc = F.concat(F.lit('# one "stray, quote\n'), quoted(key), F.lit(","), F.col("o_custkey").cast("string"), F.lit('\n#last "comment'))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))
    return columns.parse_columns(docs, "doc", SPECS["csv_hash"], ["o_orderkey"])


#: Lines of whole texts: what follows the last newline is one unless empty, and one carriage return at the end is none of it.
_LINES_SQL = "SELECT count(*) AS records, CAST(sum(strlen(CASE WHEN line LIKE '%' || chr(13) THEN left(line, -1) ELSE line END)) AS BIGINT) AS bytes FROM (SELECT unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, chr(10))) AS line FROM documents WHERE text <> '')"


@query(_LINES_SQL)
def lines_documents(spark, sf_dir):
    rows = records.records(table(spark, sf_dir, "documents"), "text", DIALECTS["lines"])
    return rows.agg(F.count("*").alias("records"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def records_crlf(spark, sf_dir):
    doc = F.concat(joined(",", "s_suppkey", "s_name", "s_acctbal"), F.lit("\r\n"))
    docs = table(spark, sf_dir, "supplier").select(doc.alias("doc"))
    return columns.parse_columns(docs, "doc", with_columns("csv", Col(0, "i64", "s_suppkey"), Col(1, "string", "s_name"), Col(2, "f64", "s_acctbal")))


@query("SELECT n_nationkey, t.i AS field_no, CASE t.i WHEN 0 THEN 0 ELSE 2 + strlen(n_name) + 1 END AS start, CASE t.i WHEN 0 THEN strlen(n_name) + 2 ELSE strlen(CAST(n_regionkey AS VARCHAR)) END AS length FROM nation, (VALUES (0), (1)) t(i)")
def field_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", joined(",", quoted(F.col("n_name")), "n_regionkey").alias("raw"))
    return records.field_spans(records.with_fields(rows, CSV), ["n_nationkey"])


@query("SELECT o_orderkey, i.k AS rec_no, o_orderstatus || i.k AS raw FROM orders, (VALUES (1), (2)) i(k)")
def records_range(spark, sf_dir):
    doc = F.concat(*[F.concat("o_orderstatus", F.lit(f"{k}\n")) for k in range(5)])
    rows = records.records(table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")), "doc", DIALECTS["lines"], ["o_orderkey"])
    return rows.filter(F.col("rec_no").between(1, 2))


@query("SELECT r_regionkey, 3 AS terminated, 3 AS records FROM region")
def terminated_records(spark, sf_dir):
    doc = F.concat(F.lit('# it is "so\n'), "r_name", F.lit(',1\n"a\nb",2\ntail'))
    return table(spark, sf_dir, "region").select("r_regionkey", records.terminated_count(doc, CSV_HASH).alias("terminated"), F.size(records.document_records(doc, CSV_HASH)).alias("records"))


@query("SELECT count(*) AS records, CAST(sum(strlen(c_name)) AS BIGINT) AS bytes FROM customer")
def lpr4_records(spark, sf_dir):
    doc = F.concat(F.lit("@r\n"), "c_name", F.lit("\n+\nqual\ntail"))
    rows = records.grouped_lines(table(spark, sf_dir, "customer").select(doc.alias("doc")), "doc", DIALECTS["fastq"])
    return rows.agg(F.count("*").alias("records"), F.sum(F.octet_length(F.get("fields", F.lit(1)))).alias("bytes"))


# --- FASTQ


def _reads(spark, sf_dir) -> DataFrame:
    seq = F.repeat(F.lit("ACGT"), (F.col("c_custkey") % 7).cast("int"))
    one = F.concat(F.lit("@"), "c_name", F.lit("\n"), seq, F.lit("\n+\n"), F.regexp_replace(seq, ".", "!"), F.lit("\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(one, one).alias("doc"))


@query("SELECT CAST(sum(2) AS BIGINT) AS records, CAST(sum(8 * (c_custkey % 7)) AS BIGINT) AS sequence_bytes, CAST(sum(8 * (c_custkey % 7)) AS BIGINT) AS quality_bytes, CAST(sum(2 * (c_custkey % 7) * (65 + 67 + 71 + 84 + 4 * 33)) AS BIGINT) AS checksum FROM customer")
def fastq_stats(spark, sf_dir):
    got = stats.fastq_checked(_reads(spark, sf_dir), "doc", "c_custkey")
    return got.agg(*[F.sum(c).alias(c) for c in ("records", "sequence_bytes", "quality_bytes", "checksum")])


_FASTQ = [
    ("ok", "@r\nAC\n+\n!!\n", None, None),
    ("empty", "", None, None),
    ("length", "@r0\nACGT\n+\n!!!\n", "LengthMismatch", 0),
    ("separator", "@r0\nACGT\n-\n!!!!\n", "BadSeparator", 9),
    ("header", "@r\nA\n+\n!\nr2\nA\n+\n!\n", "BadHeader", 9),
    ("incomplete", "@r\nA\n+\n", "IncompleteRecord", 0),
    ("trailing", "@r\nA\n+\n!\n@", "TrailingBytes", 9),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(e) if e else 'CAST(NULL AS VARCHAR)'}, CAST({'NULL' if o is None else o} AS BIGINT))" for k, _, e, o in _FASTQ) + ") t(name, error, \"offset\")")
def fastq_errors(spark, sf_dir):
    docs = spark.createDataFrame([(k, d) for k, d, _, _ in _FASTQ], "name string, doc string")
    return stats.fastq_checked(docs, "doc", "name").select("name", "error", "offset")


# --- logfmt


def _logfmt(spark, sf_dir) -> DataFrame:
    raw = F.concat(F.lit("key="), F.col("o_orderkey").cast("string"), F.lit(" status="), "o_orderstatus", F.lit(' msg="a \\"'), "o_orderpriority", F.lit('\\" b" raw='), F.col("o_custkey").cast("string"))
    return records.with_fields(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), LOGFMT)


@query("SELECT count(*) * 4 AS pairs, count(*) * 15 AS key_bytes, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderstatus) + strlen(o_orderpriority) + 6 + strlen(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS value_bytes FROM orders")
def logfmt_pairs(spark, sf_dir):
    return stats.logfmt_pairs(_logfmt(spark, sf_dir), LOGFMT).select("pairs", "key_bytes", "value_bytes")


@query("SELECT o_orderkey, t.place, CASE t.place WHEN 0 THEN 'key' WHEN 1 THEN 'status' WHEN 2 THEN 'msg' ELSE 'raw' END AS key, CASE t.place WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderstatus WHEN 2 THEN 'a \"' || o_orderpriority || '\" b' ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders, (VALUES (0), (1), (2), (3)) t(place)")
def logfmt_long(spark, sf_dir):
    return stats.logfmt_rows(_logfmt(spark, sf_dir), LOGFMT, ["o_orderkey"])


@query("SELECT CAST(sum(list_sum(list_transform(string_split('keystatusmsgraw' || CAST(o_orderkey AS VARCHAR) || o_orderstatus || 'a \"' || o_orderpriority || '\" b' || CAST(o_custkey AS VARCHAR), ''), lambda c: unicode(c)))) AS BIGINT) AS checksum FROM orders")
def logfmt_checksum(spark, sf_dir):
    return stats.logfmt_pairs(_logfmt(spark, sf_dir), LOGFMT).select(F.col("checksum").cast("bigint").alias("checksum"))


# --- NDJSON and JSON


@query("SELECT count(*) * 2 AS records FROM events")
def ndjson_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.concat("props", F.lit('\n{"s": "a\\"\nb"}')).alias("doc"))
    return stats.ndjson_lines(docs, "doc", NDJSON)


@query("SELECT count(*) AS records, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum FROM events")
def ndjson_path_sum(spark, sf_dir):
    got = stats.ndjson_sum(table(spark, sf_dir, "events").select("props"), "props", ["$.k"])
    return got.select("records", F.col("sum").cast("bigint").alias("sum"))


@query("SELECT count(*) AS records, CAST(sum(event_id + user_id) AS BIGINT) AS sum FROM events")
def ndjson_id_score(spark, sf_dir):
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "tags": ["id\\":9"], "nested": {"score": '), F.col("user_id").cast("string"), F.lit(', "ok": true}}'))
    got = stats.ndjson_sum(table(spark, sf_dir, "events").select(line.alias("line")), "line", ["$.id", "$.nested.score"])
    return got.select("records", F.col("sum").cast("bigint").alias("sum"))


def _orders_json(spark, sf_dir) -> DataFrame:
    doc = F.concat(F.lit(' {"key": '), F.col("o_orderkey").cast("string"), F.lit(', "in": [1, -2, "a]\\"{", {"c": '), F.col("o_custkey").cast("string"), F.lit('}], "s": "'), "o_orderstatus", F.lit('"} '))
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))


@query("SELECT o_orderkey, t.place, CASE t.place WHEN 0 THEN '\"key\"' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '\"in\"' WHEN 3 THEN '1' WHEN 4 THEN '-2' WHEN 5 THEN '\"a]\\\"{\"' WHEN 6 THEN '\"c\"' WHEN 7 THEN CAST(o_custkey AS VARCHAR) WHEN 8 THEN '\"s\"' ELSE '\"' || o_orderstatus || '\"' END AS scalar FROM orders, (SELECT CAST(i AS INTEGER) AS place FROM range(10) r(i)) t")
def json_scalars(spark, sf_dir):
    return _orders_json(spark, sf_dir).select("o_orderkey", F.posexplode(nested.scalars(F.col("doc"), JSON)).alias("place", "scalar"))


@query("SELECT count(*) * 4 AS integers, CAST(sum(o_orderkey + o_custkey - 1) AS BIGINT) AS sum FROM orders")
def json_int_sum(spark, sf_dir):
    return nested.integer_sum(_orders_json(spark, sf_dir), "doc", JSON)


@query("SELECT o_orderkey, CAST(t.place AS INTEGER) AS place, CASE t.place WHEN 0 THEN '\"key\"' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '\"in\"' WHEN 3 THEN '[1, -2, \"a]\\\"{\", {\"c\": ' || CAST(o_custkey AS VARCHAR) || '}]' WHEN 4 THEN '\"s\"' ELSE '\"' || o_orderstatus || '\"' END AS item, t.place = 3 AS container FROM orders, (VALUES (0), (1), (2), (3), (4), (5)) t(place)")
def json_items_level(spark, sf_dir):
    return nested.items(_orders_json(spark, sf_dir), "doc", JSON, "o_orderkey", 1)


@query("SELECT r_regionkey, CAST(t.place AS INTEGER) AS place, CASE t.place WHEN 0 THEN '{\"a\": ' || r_regionkey || '}' WHEN 1 THEN '[2, 3]' WHEN 2 THEN '{\"b\": [4]}' ELSE '5' END AS item, t.place < 3 AS container FROM region, (VALUES (0), (1), (2), (3)) t(place)")
def json_items_top(spark, sf_dir):
    doc = F.concat(F.lit(' {"a": '), F.col("r_regionkey").cast("string"), F.lit('} [2, 3]\n{"b": [4]} 5 '))
    return nested.items(table(spark, sf_dir, "region").select("r_regionkey", doc.alias("doc")), "doc", JSON, "r_regionkey", 0)


@query("SELECT o_orderkey, CAST(t.p AS BIGINT) AS pos, CAST(t.q AS BIGINT) AS partner, CAST(t.l AS BIGINT) AS level FROM orders, (VALUES (0, 10, 1), (10, 0, 1), (2, 8, 2), (8, 2, 2), (4, 5, 3), (5, 4, 3)) t(p, q, l)")
def nested_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("[1{ [], } ]").alias("doc"))
    t = nested.tape(docs, "doc", JSON, "o_orderkey")
    return t.filter("turn <> 0").select("o_orderkey", "pos", "partner", "level")


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS depth FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, CAST(1 AS BIGINT) FROM orders WHERE o_orderkey % 2 <> 0")
def nested_depth(spark, sf_dir):
    doc = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"a": ["}]"]}')).otherwise(F.lit('["[[["]'))
    t = nested.tape(table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")), "doc", JSON, "o_orderkey")
    return t.groupBy("o_orderkey").agg(F.max("level").alias("depth"))


_BROKEN = [('{"a": [1, 2}', "UnmatchedClose", 11), ("[1, 2", "UnclosedOpen", 0), ("1]", "UnmatchedClose", 1), ("}", "UnmatchedClose", 0), ("[[]", "UnclosedOpen", 0), ("[ {", "UnclosedOpen", 2), ("[]", None, None), ("7", None, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', {repr(e) if e else 'CAST(NULL AS VARCHAR)'}, CAST({'NULL' if p is None else p} AS BIGINT))" for d, e, p in _BROKEN) + ") t(doc, error, pos)")
def nested_errors(spark, sf_dir):
    docs = spark.createDataFrame([(d,) for d, _, _ in _BROKEN], "doc string")
    return nested.errors(docs, "doc", JSON, "doc")


@query("SELECT n_nationkey, CAST(t.i AS INTEGER) AS tape_idx, CAST(CASE t.i WHEN 0 THEN strlen(n_name) + 4 ELSE strlen(n_name) + 5 + strlen(CAST(n_regionkey AS VARCHAR)) END AS BIGINT) AS pos, CASE t.i WHEN 0 THEN ',' ELSE chr(10) END AS byte FROM nation, (VALUES (0), (1)) t(i)")
def structural_positions(spark, sf_dir):
    doc = F.concat(quoted(F.concat("n_name", F.lit(",\n"))), F.lit(","), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return nested.structural_index(table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("doc")), "doc", CSV, "n_nationkey")


# --- VCF


def _vcf(spark, sf_dir) -> DataFrame:
    k = F.col("l_orderkey")
    info = F.concat(F.lit("NS=3"), F.when(k % 5 != 0, F.concat(F.lit(";DP=1;DP="), F.col("l_linenumber").cast("string"))).otherwise(";DPX=4"), F.when(k % 4 != 0, F.concat(F.lit(";AF="), F.col("l_discount").cast("string"))).otherwise(";AF"), F.lit(";DB"))
    qual = F.when(k % 3 == 0, ".").otherwise(F.col("l_quantity").cast("string"))
    raw = joined("\t", F.lit("chr1"), k, F.lit("id"), "l_returnflag", F.when(k % 7 == 0, "").otherwise(F.col("l_linestatus")), qual, F.lit("PASS"), info)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    head = table(spark, sf_dir, "region").select(F.lit(None).cast("bigint").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), F.lit('##x "y\tz').alias("raw"))
    return rows.unionByName(head)


@query("SELECT l_orderkey AS pos, l_returnflag AS reference, CASE WHEN l_orderkey % 7 <> 0 THEN l_linestatus END AS alternate, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS quality, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS dp, CASE WHEN l_orderkey % 4 <> 0 THEN l_discount END AS af FROM lineitem")
def vcf_typed(spark, sf_dir):
    t = columns.typed(_vcf(spark, sf_dir), SPECS["vcf_typed"])
    return t.select("pos", F.decode("reference", "UTF-8").alias("reference"), F.decode("alternate", "UTF-8").alias("alternate"), "quality", "dp", "af")


@query("SELECT count(*) AS records, count(*) FILTER (WHERE l_orderkey % 5 <> 0) AS present, CAST(sum(l_linenumber) FILTER (WHERE l_orderkey % 5 <> 0) AS BIGINT) AS sum_dp, CAST(sum(l_orderkey) AS BIGINT) AS sum_pos FROM lineitem")
def vcf_info(spark, sf_dir):
    t = columns.typed(_vcf(spark, sf_dir), _only(SPECS["vcf_typed"], "pos", "dp"))
    return t.agg(F.count("*").alias("records"), F.count("dp").alias("present"), F.sum("dp").alias("sum_dp"), F.sum("pos").alias("sum_pos"))


@query("SELECT count(*) AS records, CAST(sum(1 + CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS primary_bytes, count(*) AS pos_values FROM lineitem")
def vcf_stats(spark, sf_dir):
    rows = records.with_fields(_vcf(spark, sf_dir).filter(~F.startswith("raw", F.lit("#"))), DIALECTS["vcf"])
    f = F.col("fields")
    got = stats.vcf_stats(rows, [cells.cast_i64(F.get(f, F.lit(1))), cells.cast_f64(F.get(f, F.lit(5)))])
    return got.select("records", "primary_bytes", "pos_values")


_VCF_QUALITY = "CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END"
_BYTES_OF = "list_sum(list_transform(range({n}), lambda k: ({x} >> (8 * k)) & 255))"
#: Quantities are whole numbers from 1 to 50, whose bits as a float follow from the power of two below them.
_VCF_CHECKSUM = f"""WITH v AS (SELECT l_orderkey, l_returnflag || CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE l_linestatus END AS alleles, CAST({_VCF_QUALITY} AS BIGINT) AS q FROM lineitem),
e AS (SELECT *, CAST(floor(log2(q)) AS BIGINT) AS e FROM v),
b AS (SELECT *, ((e + 127) << 23) + ((q - (1 << e)) << (23 - e)) AS bits FROM e)
SELECT count(*) AS records, CAST(sum(strlen(alleles)) AS BIGINT) AS primary_bytes, count(*) AS pos_values,
CAST(sum(list_sum(list_transform(string_split(alleles, ''), lambda c: unicode(c))) + {_BYTES_OF.format(n=8, x='l_orderkey')} + coalesce({_BYTES_OF.format(n=4, x='bits')}, 0)) AS DECIMAL(20, 0)) AS checksum FROM b"""


@query(_VCF_CHECKSUM)
def vcf_checksum(spark, sf_dir):
    rows = records.with_fields(_vcf(spark, sf_dir).filter(~F.startswith("raw", F.lit("#"))), DIALECTS["vcf"])
    f = F.col("fields")
    return stats.vcf_stats(rows, [cells.cast_i64(F.get(f, F.lit(1))), cells.cast_f64(F.get(f, F.lit(5)))])


# --- geo reductions


def _geo(spark, sf_dir) -> DataFrame:
    lat = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    raw = joined(",", F.lit("xx"), quoted(F.col("c_name")), F.lit("a"), F.lit("r"), F.lit(""), lat, F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(raw.alias("raw"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS latitude_values, count(*) AS longitude_values FROM customer")
def csv_geo_counts(spark, sf_dir):
    return stats.geo_stats(columns.typed(_geo(spark, sf_dir), SPECS["csv_geo"])).select("records", "latitude_values", "longitude_values")


@query()
def csv_geo_stats(spark, sf_dir):
    return stats.geo_stats(columns.typed(_geo(spark, sf_dir), SPECS["csv_geo"]))


@query("SELECT count(*) AS city_values, CAST(sum(strlen(c_name)) AS BIGINT) AS city_bytes, CAST(sum(list_sum(list_transform(string_split(c_name, ''), lambda c: unicode(c)))) AS BIGINT) AS city_checksum FROM customer")
def csv_geo_text_stats(spark, sf_dir):
    got = stats.geo_text_stats(columns.typed(_geo(spark, sf_dir), SPECS["csv_geo_text"]))
    return got.select("city_values", "city_bytes", F.col("city_checksum").cast("bigint").alias("city_checksum"))


# --- frames, blocks, streams


def _pack(width: int | str) -> Column:
    """A region's name as two frames: the length, then the bytes."""
    size = F.octet_length("r_name")
    head = F.unhex(F.lpad(F.hex(size), 2, "0")) if width == "varint" else F.unhex(F.concat(F.lpad(F.hex(size), 2, "0"), F.repeat(F.lit("0"), 2 * (width - 1))))
    one = F.concat(head, F.encode("r_name", "UTF-8"))
    return F.concat(one, one)


_FRAMES_SQL = "SELECT r_regionkey, CAST(t.i AS BIGINT) AS frame_no, CAST(t.i * (strlen(r_name) + {w}) AS BIGINT) AS start, CAST(strlen(r_name) + {w} AS BIGINT) AS len, r_name AS payload FROM region, (VALUES (0), (1)) t(i)"


@query(_FRAMES_SQL.format(w=4))
def frames_fixed(spark, sf_dir):
    files = table(spark, sf_dir, "region").select("r_regionkey", _pack(4).alias("content"))
    got = framing.frames(files, framing.Framing(4), key="r_regionkey")
    return got.select("r_regionkey", "frame_no", "start", "len", F.decode("payload", "UTF-8").alias("payload"))


@query(_FRAMES_SQL.format(w=1))
def frames_varint(spark, sf_dir):
    files = table(spark, sf_dir, "region").select("r_regionkey", _pack("varint").alias("content"))
    got = framing.frames(files, framing.Framing(0, width="varint"), key="r_regionkey")
    return got.select("r_regionkey", "frame_no", "start", "len", F.decode("payload", "UTF-8").alias("payload"))


def _pressed(files: DataFrame, key: str, block: int) -> DataFrame:
    """files (key, content) with each content as blocked gzip of blocks of so many bytes."""

    def press(batches):
        import pyarrow as pa

        for b in batches:
            out = [framing.write_bgzf(x, block) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "content"])

    return files.select(key, "content").mapInArrow(press, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


def _bgzf(spark, sf_dir) -> DataFrame:
    """Each document's text as blocked gzip of small blocks."""
    return _pressed(table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), "doc_id", 700)


@query("SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text <> ''")
def bgzf_roundtrip(spark, sf_dir):
    got = framing.decoded(framing.frames(_bgzf(spark, sf_dir), "bgzf", key="doc_id"), check_sizes=True)
    return got.agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.octet_length("payload")).alias("bytes"))


@query("SELECT doc_id, count(*) AS records, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM (SELECT doc_id, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, chr(10))) AS line FROM documents WHERE text <> '') GROUP BY doc_id")
def bgzf_records(spark, sf_dir):
    got = framing.decoded(framing.frames(_bgzf(spark, sf_dir), "bgzf", key="doc_id"))
    rows = framing.stitched_records(got, "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("records"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("SELECT s_suppkey, s_name || ' é€ ' || chr(128578) AS name, s_acctbal AS balance FROM supplier")
def bgzf_columns(spark, sf_dir):
    """Typed columns of blocked gzip whose blocks cut records and characters anywhere."""
    line = F.concat(joined(",", "s_suppkey", F.concat("s_name", F.lit(" é€ \U0001f642")), "s_acctbal"), F.lit("\n"))
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))
    files = docs.groupBy((F.col("s_suppkey") % 7).alias("part")).agg(F.encode(F.array_join(F.sort_array(F.collect_list("line")), ""), "UTF-8").alias("content"))
    got = framing.stitched_records(framing.decoded(framing.frames(_pressed(files, "part", 37), "bgzf", key="part")), "part")
    return columns.typed(got, with_columns("csv", Col(0, "i64", "s_suppkey"), Col(1, "string", "name"), Col(2, "f64", "balance")))


@query("SELECT CAST(o_orderstatus || chr(10) || '#é ' || o_orderpriority AS VARCHAR) AS key, o_custkey AS amount FROM orders")
def csv_hash_file(spark, sf_dir):
    """Comments and quotes that span lines, from files cut into blocks."""
    key = F.concat("o_orderstatus", F.lit("\n#é "), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit('# é "stray\n'), quoted(key), F.lit(","), F.col("o_custkey").cast("string")).alias("value"))
    folder = f"{streaming.shared_folder(spark, 'lines')}/csv_hash"
    rows.write.option("lineSep", "\n").text(folder)
    return columns.typed(records.file_records(spark, folder, CSV_HASH), Spec("csv_hash", CSV_HASH, SPECS["csv_hash"].columns))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS stream, CAST(t.i AS BIGINT) AS rec_no, CASE t.i WHEN 0 THEN '\"a' || chr(10) || '\"\"b\",' || o_orderstatus ELSE o_orderpriority END AS raw FROM orders, (VALUES (0), (1)) t(i)")
def stream_equals_batch(spark, sf_dir):
    doc = F.concat(F.lit('"a\n""b",'), "o_orderstatus", F.lit("\r\n"), "o_orderpriority")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("stream"), doc.alias("text"))
    return streaming.replayed(streaming.sequenced(docs, 5), CSV)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS stream, CAST(0 AS BIGINT) AS rec_no, o_orderstatus AS name, strlen(o_orderpriority) AS bases FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'last', 0 FROM orders WHERE o_orderstatus = 'F'")
def stream_grouped_lines(spark, sf_dir):
    """Four lines a record from chunked streams; the second record of most streams is cut off and dropped."""
    first = F.concat(F.lit("@"), "o_orderstatus", F.lit("\r\n"), "o_orderpriority", F.lit("\n+\n!\n"))
    second = F.when(F.col("o_orderstatus") == "F", F.lit("@last\n\n+\n\n")).otherwise(F.lit("@last\n\n+\nx"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("stream"), F.concat(first, second).alias("text"))
    rows = streaming.replayed(streaming.sequenced(docs, 7), DIALECTS["fastq"])
    return rows.select("stream", "rec_no", F.substr(F.get("fields", F.lit(0)), F.lit(2)).alias("name"), F.length(F.get("fields", F.lit(1))).cast("bigint").alias("bases"))


# --- counts, kinds, programs, states


@query("SELECT count(*) AS reads, count(*) * 4 AS pairs FROM orders")
def structural_counts(spark, sf_dir):
    """Counts read off the index alone: newlines by four, and key separators."""
    t = table(spark, sf_dir, "orders")
    read = F.concat(F.lit("@r\n"), "o_orderstatus", F.lit("\n+\n!\n"))
    reads = F.floor(records.terminated_count(read, DIALECTS["lines"]) / 4)
    line = F.concat(F.lit('a=1 b="x=y" c='), "o_orderstatus", F.lit(" d=2"))
    pairs = F.size(cells.split_live(line, LOGFMT, ("=",))) - 1
    return t.agg(F.sum(reads).alias("reads"), F.sum(pairs).cast("bigint").alias("pairs"))


@query("SELECT n_nationkey, CAST(t.p AS BIGINT) AS pos, CAST(t.q AS BIGINT) AS partner FROM nation, (VALUES (0, 3), (3, 0), (1, 2), (2, 1)) t(p, q)")
def nested_any_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("[{]}").alias("doc"))
    return nested.tape(docs, "doc", JSON, "n_nationkey", kinds=False).select("n_nationkey", "pos", "partner")


PROGRAM = """table-ir 1
format csv
structural 2c,0a
quote 22
escape none
%0 = class 22
%1 = prefix-xor %0
%2 = class 0a,2c
%3 = not %1
%4 = and %2 %3
%5 = class 0a
output %4
terminators %5
"""


@query("SELECT n_nationkey, CAST(t.i AS INTEGER) AS tape_idx, CAST(CASE t.i WHEN 0 THEN strlen(n_name) + 4 ELSE strlen(n_name) + 5 + strlen(CAST(n_regionkey AS VARCHAR)) END AS BIGINT) AS pos FROM nation, (VALUES (0), (1)) t(i)")
def bitstream_positions(spark, sf_dir):
    doc = F.concat(quoted(F.concat("n_name", F.lit(",\n"))), F.lit(","), F.col("n_regionkey").cast("string"), F.lit("\n"))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.encode(doc, "UTF-8").alias("content"))
    return bitstreams.positions(docs, "content", modules.parse_module(PROGRAM), "n_nationkey")


@query("SELECT count(*) FILTER (WHERE text <> '') > 0 AS any, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text) - strlen(replace(text, chr(10), ''))) AS BIGINT) AS newlines FROM documents")
def frames_fold(spark, sf_dir):
    """A caller's own state over inflated payloads, merged over tasks."""
    got = framing.decoded(framing.frames(_bgzf(spark, sf_dir), "bgzf", key="doc_id"))
    step = lambda state, payload: (state[0] + 1, state[1] + len(payload), state[2] + payload.count(b"\n"))
    states = framing.fold_payloads(got, lambda: (0, 0, 0), step, "blocks bigint, bytes bigint, newlines bigint")
    return states.agg((F.sum("blocks") > 0).alias("any"), F.sum("bytes").alias("bytes"), F.sum("newlines").alias("newlines"))


@query("SELECT CAST(count(*) AS BIGINT) AS frames, CAST(sum(strlen(r_name)) AS BIGINT) AS bytes FROM region")
def bgzf_canonical(spark, sf_dir):
    """The described layout in place of the walk of the extra field."""

    def press(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([framing.write_bgzf(x) for x in b.column(1).to_pylist()], pa.binary())], ["r_regionkey", "content"])

    files = table(spark, sf_dir, "region").select("r_regionkey", F.encode("r_name", "UTF-8").alias("content")).mapInArrow(press, "r_regionkey int, content binary")
    got = framing.decoded(framing.frames(files, framing.BGZF, key="r_regionkey"), check_sizes=True).filter("uncompressed > 0")
    return got.agg(F.count("*").alias("frames"), F.sum(F.octet_length("payload")).alias("bytes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_fused_agg(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
