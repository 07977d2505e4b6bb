"""Synthetic records of eight formats, for trying specs and for benches at any size.

generated() gives rows (row, raw) whose content depends on the row's number and the seed alone, so it is the same
for any number of partitions; everything is a column expression over spark.range(). `raw` is one record as written,
without its last newline; the first row of "vcf" holds the header lines too, and that of "csv_geo" is the header.
write.text() of `raw` gives files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that begin a "csv_hash" text as comments, and one of so many later ones.
COMMENT_HEAD, COMMENT_EVERY = 8, 50


class _Draws:
    """Pseudo-random columns of a row; every call is a draw of its own."""

    def __init__(self, seed: int):
        self.seed, self.at = seed, 0

    def bits(self) -> Column:
        """63 bits."""
        self.at += 1
        return F.shiftrightunsigned(F.xxhash64("row", F.lit(self.seed), F.lit(self.at)), 1)

    def below(self, n: int) -> Column:
        return self.bits() % F.lit(n)

    def one_in(self, n: int) -> Column:
        return self.below(n) == 0

    def of(self, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(len(values)) + 1).cast("int"))

    def word(self, least: int = 3, most: int = 12) -> Column:
        """Letters and digits."""
        size = (self.below(most - least + 1) + least).cast("int")
        return F.substring(F.rpad(F.lower(F.conv(self.bits().cast("string"), 10, 36)), 12, "0"), F.lit(1), size)

    def number(self, n: int) -> Column:
        return self.below(n).cast("string")

    def decimal(self, least: int, most: int) -> Column:
        """A number with six places."""
        return F.format_string("%.6f", self.below((most - least) * 1_000_000) / F.lit(1_000_000.0) + F.lit(float(least)))

    def text(self, alphabet: str, size: Column, most: int) -> Column:
        """A string of `size` characters, `most` at most."""
        digits = F.concat(*[F.sha2(self.bits().cast("string"), 256) for _ in range(-(-most // 64))])
        return F.translate(F.substring(digits, F.lit(1), size.cast("int")), "0123456789abcdef", (alphabet * 16)[:16])


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _cell(d: _Draws, *inside: str) -> Column:
    """One of ten cells is quoted, with one of `inside` in it; two are numbers."""
    kind = d.below(10)
    quoted = _quoted(F.concat(d.word(), d.of("", *inside)))
    return F.when(kind == 0, quoted).when(kind <= 2, d.number(10**9)).otherwise(d.word())


def _csv(d: _Draws) -> Column:
    return F.concat_ws(",", *[_cell(d, "a,b", "x\ny", 'q""q') for _ in range(8)])


def _csv_hash(d: _Draws) -> Column:
    comment = F.concat(F.lit("# "), d.word(), F.lit(', "quoted, noise" #section '), d.word())
    row = F.col("row")
    return F.when((row < COMMENT_HEAD) | (row % COMMENT_EVERY == 0), comment).otherwise(F.concat_ws(",", *[_cell(d, "a,b", "#c", 'q""q') for _ in range(8)]))


def _csv_geo(d: _Draws) -> Column:
    city = d.word()
    people = F.when(d.one_in(2), F.lit("")).otherwise(d.number(10**6))
    cells = F.concat_ws(",", d.word(2, 2), city, city, d.number(100), people, d.decimal(-90, 90), d.decimal(-180, 180))
    return F.when(F.col("row") == 0, F.lit("Country,City,AccentCity,Region,Population,Latitude,Longitude")).otherwise(cells)


def _tsv(d: _Draws) -> Column:
    return F.concat_ws("\t", *[d.word() for _ in range(8)])


def _logfmt(d: _Draws) -> Column:
    message = F.concat(d.word(), F.lit(" "), d.of("", '\\"', "\\\\", "a=b"), d.word())
    more = [F.when(d.below(4) > k, F.concat(F.lit(f" k{k}="), d.word())).otherwise(F.lit("")) for k in range(3)]
    return F.concat(F.lit("ts="), d.number(2 * 10**9), F.lit(" level="), d.of("debug", "info", "warn", "error"), F.lit(" msg="), _quoted(message), F.lit(" dur="), d.number(10**4), *more)


def _ndjson(d: _Draws) -> Column:
    name = F.concat(d.word(), d.of("", '\\"', "\\\\", "{"), d.word())
    tags = F.concat(_quoted(d.word()), F.lit(","), _quoted(d.word()))
    return F.concat(
        F.lit('{"id":'), d.number(10**9), F.lit(',"name":'), _quoted(name), F.lit(',"tags":['), tags, F.lit('],"nested":{"score":'), d.number(1000),
        F.lit(',"ok":'), d.of("true", "false"), F.lit('},"note":'), _quoted(d.word()), F.lit("}"),
    )


def _vcf(d: _Draws) -> Column:
    info = F.concat(F.lit("DP="), d.number(200), F.lit(";AF="), F.format_string("%.4f", d.below(10_001) / F.lit(10_000.0)))
    quality = F.when(d.one_in(10), F.lit(".")).otherwise(F.format_string("%.1f", d.below(1000) / F.lit(10.0)))
    alleles = d.of("A", "C", "G", "T"), d.of("A", "C", "G", "T", "AC", "GTT")
    cells = F.concat_ws("\t", F.concat(F.lit("chr"), (d.below(22) + 1).cast("string")), (F.col("row") * 10 + 1).cast("string"), F.lit("."), *alleles, quality, d.of("PASS", "q10"), info)
    head = "##fileformat=VCFv4.2\n##source=generated\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    return F.concat(F.when(F.col("row") == 0, F.lit(head)).otherwise(F.lit("")), cells)


def _fastq(d: _Draws) -> Column:
    size = d.below(80) + 80
    return F.concat(F.lit("@read"), F.col("row").cast("string"), F.lit(" "), d.word(), F.lit("\n"), d.text("ACGT", size, 159), F.lit("\n+\n"), d.text("@+#IFGHJ:;<=>?AB", size, 159))


#: A record of each format; the names are those of dialects, "csv_geo" is CSV.
FORMATS: dict[str, Callable[[_Draws], Column]] = {
    "csv": _csv, "csv_hash": _csv_hash, "csv_geo": _csv_geo, "tsv": _tsv, "logfmt": _logfmt, "ndjson": _ndjson, "vcf": _vcf, "fastq": _fastq,
}


def generated(spark: SparkSession, name: str, rows: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows (row, raw) of a format."""
    numbers = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "row")
    return numbers.select("row", FORMATS[name](_Draws(seed)).alias("raw"))
