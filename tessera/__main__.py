"""python -m tessera check|schema|emit SPEC: validate a spec or module file, show its schema, or print it as a module."""

from __future__ import annotations

import sys
from pathlib import Path

from tessera.sources.modules import Module, parse_module, print_module
from tessera.sources.spec import SpecError, parse


def load(path: str) -> Module:
    text = Path(path).read_text()
    return Module(parse(text)) if path.endswith(".toml") else parse_module(text)


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("check", "schema", "emit"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        module = load(args[1])
    except (SpecError, OSError) as e:
        print(f"{args[1]}: {e}", file=sys.stderr)
        return 1
    if args[0] == "schema":
        print(module.spec.schema().simpleString())
    elif args[0] == "emit":
        print(print_module(module), end="")
    else:
        print(f"{module.spec.name}: ok")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
