"""Catalyst expressions for splitting, cleaning and typing delimited text.

Quoting is pure parity: every live quote toggles, anywhere in a record, and structural characters between an
odd and the next live quote are not structural. With a backslash dialect a quote after an odd run of
escapes is not live. Texts hold one character for each input byte where offsets matter (see latin1()).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.spec import Dialect

#: Marks of a split, and of escaped pairs while quotes are counted; texts that hold them take a slower way.
MARK, PAIR, QUOTED = "\u0001", "\u0002", "\u0003"
INTEGER = r"\A[+-]?[0-9]+\z"
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NOT_FINITE = r"(?i)\A[+-]?(inf|infinity|nan)\z"
_CLASS = {"\\": r"\\", "]": r"\]", "[": r"\[", "^": r"\^", "-": r"\-", "&": r"\&"}


def char_class(chars: tuple[str, ...] | str) -> str:
    return "[" + "".join(_CLASS.get(c, c) for c in chars) + "]"


def separator(chars: tuple[str, ...] | str) -> str:
    """A pattern to split at any of chars; one character alone is written so that the JVM splits without compiling a pattern for each row."""
    if len(chars) != 1:
        return char_class(chars)
    return "\\" + chars[0] if chars[0] in ".$|()[{^?*+\\" else chars[0]


def latin1(content: Column) -> Column:
    """Bytes as a string of one character each."""
    return F.decode(content, "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    """The text whose bytes are the characters of text, as latin1() gives them; bytes that are no UTF-8 stay as they are."""
    return F.encode(text, "ISO-8859-1").cast("string")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _hidden(text: Column, dialect: Dialect) -> Column:
    """Escaped pairs as marks: they are taken from the left, so what follows an odd run is escaped."""
    e = dialect.escape_char
    return F.replace(F.replace(text, F.lit(e * 2), F.lit(PAIR)), F.lit(e + dialect.quote), F.lit(QUOTED))


def _shown(text: Column, dialect: Dialect) -> Column:
    e = dialect.escape_char
    return F.replace(F.replace(text, F.lit(QUOTED), F.lit(e + dialect.quote)), F.lit(PAIR), F.lit(e * 2))


#: How texts that hold the marks themselves are written while they are split.
_CODES = (("\u0004", "\u0004d"), (MARK, "\u0004a"), (PAIR, "\u0004b"), (QUOTED, "\u0004c"))
_HAS_MARKS = "[\u0001-\u0004]"


def _coded(text: Column) -> Column:
    for c, code in _CODES:
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def _restored(text: Column) -> Column:
    for c, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def comment_pattern(dialect: Dialect) -> str:
    """A comment line up to its newline, as a regular expression."""
    return rf"(?:\A|(?<=\n)){char_class(dialect.comment)}[^\n]*+"


def without_comments(doc: Column, dialect: Dialect) -> Column:
    """doc without its comment lines. Quoted parts are met as a whole, from the left, so that either makes the other inert."""
    q = char_class(dialect.quote)
    pattern = rf"({q}[^{dialect.quote}]*+{q}?)|{comment_pattern(dialect)}(?:\n|\z)"
    strip = lambda text: F.regexp_replace(text, pattern, "$1")
    whole = strip(doc)
    if dialect.backslash:
        through = lambda text: _shown(strip(_hidden(text, dialect)), dialect)
        whole = F.when(doc.rlike(_HAS_MARKS), _restored(through(_coded(doc)))).otherwise(through(doc))
    # most documents have none
    has = F.startswith(doc, F.lit(dialect.comment)) | F.contains(doc, F.lit("\n" + dialect.comment))
    return F.when(has, whole).otherwise(doc)


def split_live(raw: Column, dialect: Dialect, at: tuple[str, ...], limit: int = -1) -> Column:
    """raw split at every live occurrence of the characters `at`; quotes and escapes stay.

    Texts without quotes are cut into `limit` parts at most, if that is positive, of which the last holds the rest.
    """
    plain = F.split(raw, separator(at), limit) if at else F.array(raw)
    if not dialect.quote or not at:
        return plain
    quote = dialect.quote

    def parity(text: Column) -> Column:
        """text with a MARK for every live separator: segments between quotes are outside, inside, outside..."""
        outside = lambda s, i: F.when(i % 2 == 0, F.translate(s, "".join(at), MARK * len(at))).otherwise(s)
        return F.split(F.array_join(F.transform(F.split(text, separator(quote)), outside), quote), MARK)

    def marked(text: Column) -> Column:
        if not dialect.backslash:
            return parity(text)
        return F.transform(parity(_hidden(text, dialect)), lambda x: _shown(x, dialect))

    def guarded(text: Column) -> Column:
        return F.transform(marked(_coded(text)), _restored)

    # most records have no quote at all
    marks = raw.rlike(_HAS_MARKS)
    return F.when(~F.contains(raw, F.lit(quote)), plain).when(marks, guarded(raw)).otherwise(marked(raw))


def split_fields(raw: Column, dialect: Dialect, limit: int = -1) -> Column:
    """A record's raw fields; see split_live() for limit."""
    return split_live(raw, dialect, dialect.separators, limit)


def live_quotes(text: Column, dialect: Dialect) -> Column:
    """The number of quotes in a text that toggle."""
    if not dialect.quote:
        return F.lit(0)
    if dialect.backslash:
        e = dialect.escape_char
        text = F.replace(F.replace(text, F.lit(e * 2), F.lit("")), F.lit(e + dialect.quote), F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit(dialect.quote), F.lit("")))


def trim_cr(raw: Column) -> Column:
    """Without the one carriage return that may end a record."""
    return F.when(F.endswith(raw, F.lit("\r")), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def is_quoted(x: Column, quote: str) -> Column:
    return (F.length(x) >= 2) & F.startswith(x, F.lit(quote)) & F.endswith(x, F.lit(quote))


def _inner(x: Column) -> Column:
    return F.substring(x, F.lit(2), F.length(x) - 2)


def _unescape(x: Column, escape: str) -> Column:
    return F.regexp_replace(x, f"(?s){char_class(escape)}(.)", "$1")


def clean(x: Column, dialect: Dialect) -> Column:
    """A field's value: outer quotes stripped, doubled quotes or escapes resolved."""
    quote = dialect.quote
    if dialect.backslash:
        body = F.when(is_quoted(x, quote), _inner(x)).otherwise(x) if quote else x
        return F.when(F.contains(x, F.lit(dialect.escape_char)), _unescape(body, dialect.escape_char)).otherwise(body)
    if not quote:
        return x
    return F.when(is_quoted(x, quote), F.replace(_inner(x), F.lit(quote * 2), F.lit(quote))).otherwise(x)


def cast_i64(x: Column) -> Column:
    """A 64-bit integer written with digits and a sign only; else null."""
    return F.when(x.rlike(INTEGER), x.try_cast("bigint"))


def cast_f64(x: Column) -> Column:
    """A float in decimal or exponent form, inf, infinity or nan; else null."""
    special = F.when(F.lower(x).contains("nan"), F.lit(float("nan"))).when(F.startswith(x, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(DECIMAL), x.try_cast("double")).when(x.rlike(NOT_FINITE), special)


def numeric(x: Column, dialect: Dialect, cast) -> Column:
    """A number in a field; the field is cleaned only if it begins with the quote."""
    if not dialect.quote:
        return cast(x)
    return cast(F.when(F.startswith(x, F.lit(dialect.quote)), clean(x, dialect)).otherwise(x))


def info_value(x: Column, key: str) -> Column:
    """The value of key in `a=1;b=2`: of the last entry with that key, null where that has no value."""
    # what precedes is matched greedily, so the last entry is met
    last = F.regexp_extract(x, rf"(?s)\A(?:.*;)?\Q{key}\E(=[^;]*)?(?:;.*)?\z", 1)
    return F.when(F.startswith(last, F.lit("=")), F.substring(last, F.lit(2), F.length(last)))


def logfmt_value(x: Column, dialect: Dialect) -> Column:
    """A pair's value: unescaped only where it begins with the quote, stripped where it also ends with it."""
    body = F.when(is_quoted(x, dialect.quote), _inner(x)).otherwise(x)
    return F.when(F.startswith(x, F.lit(dialect.quote)), _unescape(body, dialect.escape_char)).otherwise(x)


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r\n"))


def wrapped(total: Column) -> Column:
    """A sum modulo 2**64, as decimal(20,0); nulls count 0."""
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")
    rest = F.coalesce(total, F.lit(0).cast("decimal(38,0)")) % modulus
    return F.when(rest < 0, rest + modulus).otherwise(rest).cast("decimal(20,0)")


def double_bits(x: Column) -> Column:
    """The bits of a double, as the unsigned number they are."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("decimal(20,0)")
    return F.when(x.isNotNull(), F.when(bits < 0, bits + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(bits))


def float_bits(x: Column) -> Column:
    """The bits of a double rounded to a float, unsigned."""
    bits = F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("bigint")
    return F.when(x.isNotNull(), F.pmod(bits, F.lit(1 << 32)))


def little_endian_sum(bits: Column, width: int) -> Column:
    """The sum of the bytes of a number's lowest width bytes; null counts 0. bits is a bigint, whose sign bit is a bit."""
    parts = [F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255)) for k in range(width)]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return F.coalesce(out, F.lit(0).cast("bigint"))


def byte_sum(content: Column) -> Column:
    """The sum of the values of a binary's bytes.

    Each byte is two hexadecimal digits; the digits' sums are read off by counting the 16 digits at even and
    odd places, which stays in the JVM.
    """
    digits = F.hex(content)
    high, low = F.regexp_replace(digits, "(.).", "$1"), F.regexp_replace(digits, ".(.)", "$1")

    def total(x: Column) -> Column:
        n = F.length(x)
        out = F.lit(0).cast("bigint")
        for v, d in enumerate("0123456789ABCDEF"):
            if v:
                out = out + (n - F.length(F.replace(x, F.lit(d), F.lit("")))) * v
        return out

    return _let(high, lambda h: _let(low, lambda w: total(h) * 16 + total(w)))
