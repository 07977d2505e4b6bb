"""The textual module form: a header line `<word>-ir 1`, surface directives, a frame, columns, and a bitstream program.

parse_module() reads it into a Spec, an optional Framing and the program; print_module() writes it. Queries use the
Spec as any other; the program can be run as it is by operators.bitstreams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.sources.framing import Framing, FramingError, SizeField
from tessera.sources.spec import Column, Dialect, Spec, SpecError

VERSION = 1
#: Operands of each operation that takes nodes.
ARITY = {"not": 1, "and": 2, "or": 2, "xor": 2, "shl1": 1, "shl1-seeded": 1, "prefix-xor": 1, "add": 2, "regions": 3}
_WIDTHS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "varint": "varint"}
_ENDS = ("output", "terminators", "nest-open", "nest-close")


@dataclass(frozen=True)
class Node:
    """op with node numbers; a class has its bytes, a const its pattern."""

    op: str
    args: tuple[int, ...] = ()
    value: frozenset[int] | int | None = None


@dataclass(frozen=True)
class Module:
    spec: Spec
    nodes: tuple[Node, ...] = ()
    ends: dict[str, int] = field(default_factory=dict)
    framing: Framing | None = None


def _byte(text: str) -> str:
    if not re.fullmatch("[0-9a-fA-F]{2}", text):
        raise SpecError(f"{text!r} is not a byte of two hexadecimal digits")
    return chr(int(text, 16))


def _bytes(text: str) -> list[str]:
    return [] if text == "-" else [_byte(x) for x in text.split(",")]


def _class(text: str) -> frozenset[int]:
    out: set[int] = set()
    for part in [] if text == "-" else text.split(","):
        low, _, high = part.partition("-")
        a, b = ord(_byte(low)), ord(_byte(high or low))
        if b < a:
            raise SpecError(f"the range {part} runs backwards")
        out |= set(range(a, b + 1))
    return frozenset(out)


def _framing(words: list[str]) -> Framing:
    given = dict(w.partition("=")[::2] for w in words)
    try:
        made: dict = {k: int(given.pop(n)) for k, n in (("header", "header"), ("length_at", "length-at"), ("adjust", "adjust"), ("trailer", "trailer")) if n in given}
        made["width"] = _WIDTHS[given.pop("width")]
        made |= {k: given.pop(k) for k in ("endian", "counts") if k in given}
        if "magic" in given:
            at, _, raw = given.pop("magic").partition(":")
            made["magic"] = (int(at), "".join(_bytes(raw)).encode("latin-1"))
        if "uncompressed" in given:
            at, width, endian = given.pop("uncompressed").split(":")
            made["uncompressed"] = SizeField(int(at), _WIDTHS[width], endian)
        made["skip_empty"] = given.pop("skip-empty", "false") == "true"
        if given:
            raise SpecError(f"unknown frame fields {', '.join(given)}")
        return Framing(**{"header": 0} | made).validate()
    except (KeyError, ValueError, FramingError) as e:
        raise SpecError(f"bad frame: {e}") from e


def _node(text: str, before: int) -> Node:
    op, *rest = text.split()
    if op == "class" and len(rest) == 1:
        return Node(op, value=_class(rest[0]))
    if op == "const" and len(rest) == 1:
        try:
            value = int(rest[0], 0)
        except ValueError as e:
            raise SpecError(f"{rest[0]!r} is not a number") from e
        if not 0 <= value < 1 << 64:
            raise SpecError("a const has 64 bits")
        return Node(op, value=value)
    if op not in ARITY or len(rest) != ARITY[op]:
        raise SpecError(f"no operation {text!r}")
    return Node(op, tuple(_reference(r, before) for r in rest))


def _reference(text: str, before: int) -> int:
    if not re.fullmatch(r"%\d+", text) or int(text[1:]) >= before:
        raise SpecError(f"{text} is no earlier node")
    return int(text[1:])


def parse_module(text: str) -> Module:
    lines = [x.split(";")[0].strip() for x in text.splitlines()]
    lines = [x for x in lines if x]
    head = re.fullmatch(r"\w+-ir (\d+)", lines[0]) if lines else None
    if not head or int(head[1]) != VERSION:
        raise SpecError(f"the first line must be a header of version {VERSION}")
    name, framing, nodes, ends, columns, seen = None, None, [], {}, [], set()
    surface: dict = {}
    for line in lines[1:]:
        word, *rest = line.split()
        if word.startswith("%"):
            k, _, what = line.partition("=")
            if k.strip() != f"%{len(nodes)}":
                raise SpecError(f"{k.strip()} is out of order")
            nodes.append(_node(what.strip(), len(nodes)))
            continue
        if word != "column" and word in seen:
            raise SpecError(f"{word} is given twice")
        seen.add(word)
        if word == "frame":
            framing = _framing(rest)
        elif word == "column" and len(rest) in (3, 4):
            key = rest[3].partition("=")[2] if len(rest) == 4 and rest[3].startswith("info=") else None
            columns.append(Column(int(rest[0]), rest[2], rest[1], key))
        elif word == "escape" and rest[:1] == ["none"]:
            surface["escape"] = "none"
        elif word == "escape" and len(rest) == 2 and rest[0] == "backslash":
            surface |= {"escape": "backslash", "escape_char": _byte(rest[1])}
        elif len(rest) != 1:
            raise SpecError(f"can't read {line!r}")
        elif word == "format":
            name = rest[0]
        elif word == "structural":
            surface["structural"] = tuple(_bytes(rest[0]))
        elif word in ("quote", "comment"):
            surface[word] = _byte(rest[0])
        elif word == "nesting":
            surface[word] = tuple(tuple(map(_byte, p.split(":"))) for p in rest[0].split(","))
        elif word == "lines-per-record":
            surface["lines_per_record"] = int(rest[0])
        elif word in _ENDS:
            ends[word] = _reference(rest[0], len(nodes))
        else:
            raise SpecError(f"can't read {line!r}")
    if name is None or "structural" not in surface:
        raise SpecError("format and structural are required")
    if nodes and not {"output", "terminators"} <= ends.keys():
        raise SpecError("a program names its output and terminators")
    return Module(Spec(name, Dialect(**surface), tuple(columns)).validate(), tuple(nodes), ends, framing)


def _hex(chars) -> str:
    return ",".join(f"{ord(c):02x}" for c in chars) or "-"


def _print_node(node: Node) -> str:
    if node.op == "class":
        return "class " + (",".join(f"{b:02x}" for b in sorted(node.value)) or "-")
    if node.op == "const":
        return f"const {node.value:#018x}"
    return " ".join([node.op, *(f"%{a}" for a in node.args)])


def print_module(module: Module, word: str = "table") -> str:
    d, f = module.spec.dialect, module.framing
    out = [f"{word}-ir {VERSION}", f"format {module.spec.name}", f"structural {_hex(d.structural)}"]
    out += [f"quote {_hex(d.quote)}"] if d.quote else []
    out.append(f"escape backslash {_hex(d.escape_char)}" if d.backslash else "escape none")
    out += [f"comment {_hex(d.comment)}"] if d.comment else []
    out += ["nesting " + ",".join(f"{_hex(a)}:{_hex(b)}" for a, b in d.nesting)] if d.nesting else []
    out += [f"lines-per-record {d.lines_per_record}"] if d.lines_per_record > 1 else []
    if f:
        names = {v: k for k, v in _WIDTHS.items()}
        line = f"frame header={f.header} length-at={f.length_at} width={names[f.width]} endian={f.endian} counts={f.counts} adjust={f.adjust} trailer={f.trailer}"
        line += f" magic={f.magic[0]}:{_hex(f.magic[1].decode('latin-1'))}" if f.magic else ""
        line += f" uncompressed={f.uncompressed.at}:{names[f.uncompressed.width]}:{f.uncompressed.endian}" if f.uncompressed else ""
        out.append(line + " skip-empty=true" * f.skip_empty)
    out += [f"column {c.index} {c.label} {c.type}" + (f" info={c.info_key}" if c.info_key else "") for c in module.spec.columns]
    out += [f"%{i} = {_print_node(n)}" for i, n in enumerate(module.nodes)]
    out += [f"{k} %{v}" for k, v in module.ends.items()]
    return "\n".join(out) + "\n"
