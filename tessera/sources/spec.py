"""Format specs: dialect, columns, and their TOML form."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: Column types and what they become.
TYPES = {"i64": T.LongType(), "f64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
ESCAPES = ("none", "doubled", "backslash")
MAX_COLUMNS = 32
_BYTE_ESCAPES = {r"\n": "\n", r"\t": "\t", r"\r": "\r", r"\\": "\\", r"\"": '"'}
_RESERVED = {"data", "rows"}
_SUFFIXES = ("", "_valid", "_offsets", "_data")


class SpecError(ValueError):
    """A spec that breaks a rule."""


@dataclass(frozen=True)
class Dialect:
    """Surface conventions. structural holds separators and terminators, one character each."""

    structural: tuple[str, ...]
    quote: str | None = None
    escape: str = "none"
    escape_char: str = "\\"
    comment: str | None = None
    nesting: tuple[tuple[str, str], ...] = ()
    lines_per_record: int = 1

    @property
    def separators(self) -> tuple[str, ...]:
        brackets = {c for pair in self.nesting for c in pair}
        return tuple(c for c in self.structural if c != "\n" and c not in brackets)

    @property
    def framed_by_lines(self) -> bool:
        return "\n" in self.structural

    @property
    def backslash(self) -> bool:
        return self.escape == "backslash"

    def validate(self) -> Dialect:
        if not self.structural:
            raise SpecError("structural must not be empty")
        for c in (*self.structural, *filter(None, (self.quote, self.comment))):
            if len(c) != 1 or ord(c) > 127:
                raise SpecError(f"{c!r} is not one ASCII byte")
        if self.escape not in ESCAPES:
            raise SpecError(f"escape must be one of {', '.join(ESCAPES)}")
        if self.comment is not None and self.comment in ("\n", self.quote):
            raise SpecError("comment must not be a line terminator or the quote")
        flat = [c for pair in self.nesting for c in pair]
        if len(set(flat)) != len(flat):
            raise SpecError("nesting brackets must be distinct")
        if any(c in ("\n", self.quote) or self.backslash and c == self.escape_char for c in flat):
            raise SpecError("nesting brackets must not be the terminator, the quote or the escape")
        if self.lines_per_record < 1:
            raise SpecError("lines_per_record must be a positive integer")
        if self.lines_per_record > 1 and (self.structural != ("\n",) or self.quote or self.comment or self.escape != "none" or self.nesting):
            raise SpecError("lines_per_record > 1 needs a format of lines only")
        return self


@dataclass(frozen=True)
class Column:
    index: int
    type: str
    name: str | None = None
    info_key: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.info_key or f"c{self.index}"


@dataclass(frozen=True)
class Spec:
    name: str
    dialect: Dialect
    columns: tuple[Column, ...] = field(default=())

    def validate(self) -> Spec:
        self.dialect.validate()
        if len(self.columns) > MAX_COLUMNS:
            raise SpecError(f"at most {MAX_COLUMNS} columns")
        taken: set[str] = set()
        for c in self.columns:
            if c.index < 0:
                raise SpecError("index must not be negative")
            if c.type not in TYPES:
                raise SpecError(f"type must be one of {', '.join(TYPES)}")
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c.label) or c.label in _RESERVED:
                raise SpecError(f"{c.label!r} can't name a column")
            if c.info_key is not None:
                if not c.info_key or set(c.info_key) & set("=;"):
                    raise SpecError("info_key must not be empty nor hold = or ;")
                if c.type not in ("i64", "f64"):
                    raise SpecError("an info_key column is i64 or f64")
            made = {c.label + s for s in _SUFFIXES}
            if made & taken:
                raise SpecError(f"column {c.label} collides with another")
            taken |= made
        return self

    def schema(self) -> T.StructType:
        fields = []
        for c in self.columns:
            extra = {"index": c.index} | ({"info_key": c.info_key} if c.info_key else {})
            fields.append(T.StructField(c.label, TYPES[c.type], True, extra))
        return T.StructType(fields)

    def to_text(self) -> str:
        """The spec as TOML; parse() reads it back."""
        quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
        d = self.dialect
        brackets = {c for pair in d.nesting for c in pair}
        out = [f"name = {quoted(self.name)}", f"structural = [{', '.join(quoted(c) for c in d.structural if c not in brackets)}]"]
        if d.quote:
            out.append(f"quote = {quoted(d.quote)}")
        if d.escape != "none":
            out.append(f"escape = {quoted(d.escape)}")
        if d.escape_char != "\\":
            out.append(f"escape_char = {quoted(d.escape_char)}")
        if d.comment:
            out.append(f"comment = {quoted(d.comment)}")
        if d.nesting:
            out.append(f"nesting = [{', '.join(quoted(a + b) for a, b in d.nesting)}]")
        if d.lines_per_record > 1:
            out.append(f"lines_per_record = {d.lines_per_record}")
        for c in self.columns:
            out += ["", "[[columns]]", f"index = {c.index}", f"type = {quoted(c.type)}"]
            out += [f"name = {quoted(c.name)}"] if c.name else []
            out += [f"info_key = {quoted(c.info_key)}"] if c.info_key else []
        return "\n".join(out) + "\n"


def one_byte(text: object) -> str:
    """A one-byte string, which may be written as an escape."""
    if not isinstance(text, str):
        raise SpecError(f"{text!r} is not a string")
    if len(text) == 2 and text[0] == "\\":
        if text not in _BYTE_ESCAPES:
            raise SpecError(f"unknown escape {text!r}")
        return _BYTE_ESCAPES[text]
    if len(text.encode()) != 1:
        raise SpecError(f"{text!r} is not one byte")
    return text


def _whole(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise SpecError(f"{what} must be an integer")
    return value


def parse(text: str) -> Spec:
    """A spec from TOML, validated."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SpecError(str(e)) from e
    if not isinstance(given.get("name"), str):
        raise SpecError("name must be a string")
    if not isinstance(given.get("structural"), list):
        raise SpecError("structural must be an array of one-byte strings")
    structural = [one_byte(c) for c in given["structural"]]
    nesting = []
    for pair in given.get("nesting", []):
        if not isinstance(pair, str) or len(pair) != 2:
            raise SpecError("nesting must hold strings of two brackets")
        nesting.append((pair[0], pair[1]))
        structural += [c for c in pair if c not in structural]
    dialect = Dialect(
        tuple(structural),
        one_byte(given["quote"]) if "quote" in given else None,
        given.get("escape", "none"),
        one_byte(given.get("escape_char", "\\\\")),
        one_byte(given["comment"]) if "comment" in given else None,
        tuple(nesting),
        _whole(given.get("lines_per_record", 1), "lines_per_record"),
    )
    columns = []
    for i, c in enumerate(given.get("columns", [])):
        if not isinstance(c, dict):
            raise SpecError(f"columns[{i}] must be a table")
        for key in ("name", "info_key"):
            if key in c and not isinstance(c[key], str):
                raise SpecError(f"columns[{i}]: {key} must be a string")
        if c.get("type") not in TYPES:
            raise SpecError(f"columns[{i}]: type must be one of {', '.join(TYPES)}")
        columns.append(Column(_whole(c.get("index"), f"columns[{i}]: index"), c["type"], c.get("name"), c.get("info_key")))
    return Spec(given["name"], dialect, tuple(columns)).validate()


def _dialect(structural: str, quote: str | None = None, **more) -> Dialect:
    return Dialect(tuple(structural), quote, **more).validate()


#: The dialects that come with the library.
DIALECTS = {
    "csv": _dialect(",\n", '"', escape="doubled"),
    "tsv": _dialect("\t\n"),
    "psv": _dialect("|\n"),
    "csv_semicolon": _dialect(";\n", '"', escape="doubled"),
    "logfmt": _dialect(" =\n", '"', escape="backslash"),
    "multi": _dialect(",;|\t: /=&\n", '"', escape="doubled"),
    "csv_hash": _dialect(",\n", '"', escape="doubled", comment="#"),
    "vcf": _dialect("\t\n", comment="#"),
    "lines": _dialect("\n"),
    "ndjson": _dialect("\n", '"', escape="backslash"),
    "json": _dialect("{}[],:", '"', escape="backslash", nesting=(("{", "}"), ("[", "]"))),
    "fastq": _dialect("\n", lines_per_record=4),
}

#: Typed specs that come with the library.
SPECS = {
    "csv_typed": Spec("csv_typed", DIALECTS["csv"], (Column(0, "i64", "id"), Column(1, "string", "title"), Column(2, "f64", "value"), Column(4, "bytes", "label"))),
    "csv_geo": Spec("csv_geo", DIALECTS["csv"], (Column(5, "f64", "latitude"), Column(6, "f64", "longitude"))),
    "csv_geo_text": Spec("csv_geo_text", DIALECTS["csv"], (Column(1, "string", "city"), Column(5, "f64", "latitude"), Column(6, "f64", "longitude"))),
    "csv_hash": Spec("csv_hash", DIALECTS["csv_hash"], (Column(0, "string", "key"), Column(1, "i64", "amount"))),
    "vcf_typed": Spec(
        "vcf_typed",
        DIALECTS["vcf"],
        (Column(1, "i64", "pos"), Column(3, "bytes", "reference"), Column(4, "bytes", "alternate"), Column(5, "f64", "quality"), Column(7, "i64", "dp", "DP"), Column(7, "f64", "af", "AF")),
    ),
}


def with_columns(dialect: str | Dialect, *columns: Column, name: str = "spec") -> Spec:
    base = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    return Spec(name, replace(base), columns).validate()
