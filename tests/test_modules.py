import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import bitstreams
from tessera.plans.registry import PROGRAM
from tessera.sources import framing
from tessera.sources.framing import BGZF
from tessera.sources.modules import Module, parse_module, print_module
from tessera.sources.spec import DIALECTS, SPECS, SpecError
from tests import scalar
from tests.test_formats import ALPHABETS, texts

#: Odd escape runs by addition: runs that begin at even places carry into what follows them, and so those at odd ones.
LOGFMT = """table-ir 1
format logfmt
structural 20,3d,0a
quote 22
escape backslash 5c
%0 = class 5c
%1 = const 0x5555555555555555
%2 = shl1 %0
%3 = not %2
%4 = and %0 %3
%5 = and %4 %1
%6 = add %0 %5
%7 = not %0
%8 = and %6 %7
%9 = not %1
%10 = and %8 %9
%11 = and %4 %9
%12 = add %0 %11
%13 = and %12 %7
%14 = and %13 %1
%15 = or %10 %14
%16 = class 22
%17 = not %15
%18 = and %16 %17
%19 = prefix-xor %18
%20 = class 20,3d,0a
%21 = not %19
%22 = and %20 %21
%23 = class 0a
output %22
terminators %23
"""
HASH = """table-ir 1
format csv_hash
structural 2c,0a
quote 22
escape none
comment 23
%0 = class 22
%1 = class 0a
%2 = shl1-seeded %1
%3 = class 23
%4 = and %3 %2
%5 = regions %0 %4 %1
%6 = class 2c,0a
%7 = not %5
%8 = and %6 %7
output %8
terminators %1
"""


@pytest.mark.parametrize("name,program", [("csv", PROGRAM), ("logfmt", LOGFMT), ("csv_hash", HASH)])
def test_programs_find_what_a_plain_reading_finds(name, program):
    module = parse_module(program)
    for text in texts(ALPHABETS[name], 300, name, 200):
        bits = bitstreams.evaluate(module.nodes, text.encode())[module.ends["output"]]
        assert np.flatnonzero(bits).tolist() == scalar.structurals(text, DIALECTS[name]), repr(text)


@pytest.mark.parametrize("text", [PROGRAM, LOGFMT, HASH])
def test_round_trip(text):
    module = parse_module(text)
    assert print_module(module) == print_module(parse_module(print_module(module)))
    whole = Module(SPECS["vcf_typed"], framing=BGZF)
    assert parse_module(print_module(whole)).framing == BGZF
    assert parse_module(print_module(Module(SPECS["vcf_typed"]))).spec == SPECS["vcf_typed"]


@pytest.mark.parametrize(
    "old,new",
    [("table-ir 1", "table-ir 2"), ("%1 = prefix-xor %0", "%1 = prefix-xor %1"), ("%1 =", "%7 ="), ("output %4", "output %9"), ("structural 2c,0a", ""), ("class 22", "class 2"), ("class 22", "class 30-20"), ("quote 22", "quote 22\nquote 23"), ("output %4", ""), ("and %2 %3", "and %2"), ("quote 22", "nothing 22")],
)
def test_malformed(old, new):
    with pytest.raises(SpecError):
        parse_module(PROGRAM.replace(old, new, 1))


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.toml").write_text(SPECS["csv_typed"].to_text())
    (tmp_path / "b.ir").write_text(PROGRAM)
    assert [main(["check", str(tmp_path / n)]) for n in ("a.toml", "b.ir", "none")] == [0, 0, 1]
    assert main(["schema", str(tmp_path / "a.toml")]) == 0 and main(["emit", str(tmp_path / "b.ir")]) == 0 and main([]) == 2
    assert "struct<id:bigint,title:string,value:double,label:binary>" in capsys.readouterr().out


def test_block_compressed_vcf(spark, tmp_path):
    rng, lines, want = random.Random(2), ['##head "x'], []
    for i in range(400):
        dp, af = rng.choice([None, rng.randint(0, 99)]), rng.choice([None, 0.25])
        info = ";".join(([f"DP={dp}"] if dp is not None else []) + ([f"AF={af}"] if af else []) + ["NS=1"])
        lines.append(f"1\t{i}\t.\tA\tG\t{'.' if i % 3 else 7.5}\tPASS\t{info}")
        want.append((i, None if i % 3 else 7.5, dp, af))
    (tmp_path / "x.vcf.gz").write_bytes(framing.write_bgzf("\n".join(lines).encode(), 333))
    got = framing.read_vcf_gz(spark, str(tmp_path / "x.vcf.gz"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert got.agg(F.count("dp")).first()[0] == sum(w[2] is not None for w in want)
