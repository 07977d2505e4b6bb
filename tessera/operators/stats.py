"""One-row reductions over records: partial and final aggregates, with no rows materialised in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import byte_sum, clean, double_bits, float_bits, little_endian_sum, logfmt_value, split_live, wrapped
from tessera.sources.spec import Dialect

#: Ordinals of REF and ALT in a VCF record.
VCF_ALLELES = (3, 4)


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")


def _wrapping(x: Column) -> Column:
    return wrapped(F.sum(x.cast("decimal(20,0)")))


def field_bytes(fields: DataFrame, dialect: Dialect) -> DataFrame:
    """(fields, bytes) over rows with `fields`: their number and the bytes of their values."""
    size = F.aggregate("fields", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(clean(x, dialect)))
    return fields.agg(_sum(F.size("fields")).alias("fields"), _sum(size).alias("bytes"))


def _with_bits(rows: DataFrame) -> DataFrame:
    """Bits are projected first: an aggregate does not take the reflective call that reads them."""
    return rows.withColumns({f"{c}_bits": double_bits(F.col(c)) for c in ("latitude", "longitude")})


def geo_stats(rows: DataFrame) -> DataFrame:
    """Over typed rows (latitude, longitude): counts and wrapping sums of the values' bits."""
    return _with_bits(rows).agg(
        F.count("*").alias("records"),
        F.count("latitude").alias("latitude_values"),
        F.count("longitude").alias("longitude_values"),
        _wrapping(F.col("latitude_bits")).alias("latitude_checksum"),
        _wrapping(F.col("longitude_bits")).alias("longitude_checksum"),
    )


def geo_text_stats(rows: DataFrame) -> DataFrame:
    """As geo_stats(), and of city: how many, their bytes and the sum of those."""
    return _with_bits(rows).agg(
        F.count("*").alias("records"),
        F.count("city").alias("city_values"),
        _sum(F.octet_length("city")).alias("city_bytes"),
        _wrapping(byte_sum(F.encode("city", "UTF-8"))).alias("city_checksum"),
        F.count("latitude").alias("latitude_values"),
        F.count("longitude").alias("longitude_values"),
        _wrapping(F.col("latitude_bits")).alias("latitude_checksum"),
        _wrapping(F.col("longitude_bits")).alias("longitude_checksum"),
    )


def vcf_stats(fields: DataFrame, typed: list[Column]) -> DataFrame:
    """Over rows with `fields`: the records, the bytes of REF and ALT, parsed positions, and a checksum.

    The checksum sums bytes: those of REF and ALT, the 8 of each position and the 4 of each quality as a float, both
    little-endian, where they parse. typed: pos and quality of a row.
    """
    pos, quality = typed
    alleles = [F.coalesce(F.get("fields", F.lit(k)), F.lit("")) for k in VCF_ALLELES]
    text = F.concat(*alleles)
    values = fields.select(text.alias("text"), pos.alias("pos"), float_bits(quality).alias("bits"))
    check = byte_sum(F.encode("text", "UTF-8")) + little_endian_sum(F.col("pos"), 8) + little_endian_sum(F.col("bits"), 4)
    rows = values.select(F.octet_length("text").alias("bytes"), "pos", check.alias("check"))
    return rows.agg(F.count("*").alias("records"), _sum(F.col("bytes")).alias("primary_bytes"), F.count("pos").alias("pos_values"), _wrapping(F.col("check")).alias("checksum"))


def logfmt_pairs(fields: DataFrame, dialect: Dialect) -> DataFrame:
    """(pairs, key_bytes, value_bytes, checksum): fields alternate key and value; a last odd one is dropped."""
    n = F.floor(F.size("fields") / 2).cast("int")
    pair = lambda i: F.struct(F.get("fields", i * 2).alias("k"), logfmt_value(F.get("fields", i * 2 + 1), dialect).alias("v"))
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair))
    rows = fields.select(F.explode(pairs).alias("p")).select(F.encode("p.k", "UTF-8").alias("k"), F.encode("p.v", "UTF-8").alias("v"))
    return rows.agg(
        F.count("*").alias("pairs"),
        _sum(F.octet_length("k")).alias("key_bytes"),
        _sum(F.octet_length("v")).alias("value_bytes"),
        _wrapping(byte_sum(F.col("k")) + byte_sum(F.col("v"))).alias("checksum"),
    )


def logfmt_rows(fields: DataFrame, dialect: Dialect, keep: list[str]) -> DataFrame:
    """Rows (*keep, place, key, value), one for each pair."""
    n = F.floor(F.size("fields") / 2).cast("int")
    pair = lambda i: F.struct(F.get("fields", i * 2).alias("k"), logfmt_value(F.get("fields", i * 2 + 1), dialect).alias("v"))
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair))
    return fields.select(*keep, F.posexplode(pairs).alias("place", "p")).select(*keep, "place", F.col("p.k").alias("key"), F.col("p.v").alias("value"))


def ndjson_lines(docs: DataFrame, doc: str, dialect: Dialect) -> DataFrame:
    """(records): live newlines, and one more where a document does not end with a newline; blank lines count."""
    n = F.size(split_live(F.col(doc), dialect, ("\n",)))
    rest = F.when((F.col(doc) == "") | F.endswith(doc, F.lit("\n")), n - 1).otherwise(n)
    return docs.agg(_sum(rest).alias("records"))


def ndjson_sum(rows: DataFrame, line: str, paths: list[str]) -> DataFrame:
    """(records, sum): over non-blank lines the wrapping sum of the integers at paths; a line without one raises."""
    parsed = rows.filter(F.trim(line) != "").select(F.parse_json(line).alias("j"))
    found = [F.variant_get("j", p, "bigint") for p in paths]
    whole = found[0]
    for x in found[1:]:
        whole = whole + x
    need = F.when(whole.isNull(), F.raise_error(F.lit("a line lacks one of the paths")).cast("bigint")).otherwise(whole)
    return parsed.agg(F.count("*").alias("records"), _wrapping(need).alias("sum"))


def fastq_checked(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """Rows (key, error, offset, records, sequence_bytes, quality_bytes, checksum) of documents of one byte a character.

    error is null or that of the first bad place: IncompleteRecord, BadHeader, BadSeparator, LengthMismatch,
    TrailingBytes. Carriage returns are not trimmed, and the last newline is required. A file with an error
    has no counts.
    """
    lines = F.split(doc, "\n")
    base = docs.select(key, F.col(doc).alias("_doc"), lines.alias("_lines"))
    body = F.size("_lines") - 1
    groups = F.floor(body / 4).cast("int")
    base = base.withColumn("_n", groups).withColumn("_body", body)
    at = lambda i, k: F.get("_lines", i * 4 + k)
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("qual"))

    def step(a: Column, i: Column) -> Column:
        head, seq, plus, qual = (at(i, k) for k in range(4))
        plus_at = a["pos"] + F.length(head) + F.length(seq) + 2
        error = (
            F.when(a["error"].isNotNull(), a["error"])
            .when(~F.startswith(head, F.lit("@")), "BadHeader")
            .when(~F.startswith(plus, F.lit("+")), "BadSeparator")
            .when(F.length(seq) != F.length(qual), "LengthMismatch")
        )
        offset = F.when(a["error"].isNotNull(), a["offset"]).when(error == "BadHeader", a["pos"]).when(error == "BadSeparator", plus_at).when(error == "LengthMismatch", i.cast("bigint"))
        size = F.length(head) + F.length(seq) + F.length(plus) + F.length(qual) + 4
        return F.struct((a["pos"] + size).alias("pos"), error.alias("error"), offset.alias("offset"), (a["seq"] + F.length(seq)).alias("seq"), (a["qual"] + F.length(qual)).alias("qual"))

    fold = F.aggregate(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>")), start, step)
    base = base.withColumn("_a", fold)
    tail = F.get("_lines", F.size("_lines") - 1)
    left = F.col("_body") - F.col("_n") * 4
    error = (
        F.when(F.col("_a.error").isNotNull(), F.col("_a.error"))
        .when((left == 3) & (tail == ""), "IncompleteRecord")
        .when(left > 0, "IncompleteRecord")
        .when(tail != "", F.when(F.col("_n") > 0, "TrailingBytes").otherwise("IncompleteRecord"))
    )
    base = base.withColumn("error", error).withColumn("_ok", F.col("error").isNull())
    cells = F.array_join(F.flatten(F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array(at(i, 1), at(i, 3)))).otherwise(F.array().cast("array<array<string>>"))), "")
    return base.select(
        key,
        "error",
        F.coalesce(F.col("_a.offset"), F.when(F.col("error").isNotNull(), F.col("_a.pos"))).alias("offset"),
        F.when(F.col("_ok"), F.col("_n").cast("bigint")).alias("records"),
        F.when(F.col("_ok"), F.col("_a.seq")).alias("sequence_bytes"),
        F.when(F.col("_ok"), F.col("_a.qual")).alias("quality_bytes"),
        F.when(F.col("_ok"), byte_sum(F.encode(cells, "ISO-8859-1"))).alias("checksum"),
    )


def filtered_sum(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    """(count, sum) of a typed column over a threshold.

    The condition is in the aggregate: a filter would be pushed below the columns and split each record again.
    """
    over = F.when(F.col(column) > threshold, F.col(column))
    return rows.agg(F.count(over).alias("count"), F.sum(over).alias("sum"))
