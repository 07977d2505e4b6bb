import pytest

from tessera.sources.spec import DIALECTS, SPECS, Dialect, Spec, SpecError, one_byte, parse

GOOD = 'name = "n"\nstructural = [",", "\\n"]\n'


@pytest.mark.parametrize("spec", [*SPECS.values(), *(Spec(k, d) for k, d in DIALECTS.items())], ids=lambda s: s.name)
def test_round_trip(spec):
    back = parse(spec.to_text())
    assert back.columns == spec.columns and set(back.dialect.structural) == set(spec.dialect.structural)
    assert (back.dialect.quote, back.dialect.escape, back.dialect.comment, back.dialect.nesting) == (spec.dialect.quote, spec.dialect.escape, spec.dialect.comment, spec.dialect.nesting)


@pytest.mark.parametrize(
    "extra",
    [
        'quote = "ab"', 'escape = "other"', 'comment = "\\n"', 'quote = "#"\ncomment = "#"', 'nesting = ["{"]', "lines_per_record = 0", "lines_per_record = 4", "lines_per_record = true",
        '[[columns]]\nindex = 0', '[[columns]]\nindex = -1\ntype = "i64"', '[[columns]]\nindex = 0\ntype = "date"', '[[columns]]\nindex = 0\ntype = "i64"\nname = "data"',
        '[[columns]]\nindex = 0\ntype = "string"\ninfo_key = "A"', '[[columns]]\nindex = 0\ntype = "i64"\ninfo_key = "A;"', '[[columns]]\nindex = 0\ntype = "i64"\nname = "x"\n[[columns]]\nindex = 1\ntype = "i64"\nname = "x_valid"',
        "\n".join(f'[[columns]]\nindex = {i}\ntype = "i64"' for i in range(33)), "nonsense",
    ],
)
def test_rules(extra):
    with pytest.raises(SpecError):
        parse(GOOD + extra)


def test_bytes_and_schema():
    assert [one_byte(x) for x in ("a", "\\n", "\\t", "\\\\")] == ["a", "\n", "\t", "\\"]
    with pytest.raises(SpecError):
        one_byte("\\q")
    assert SPECS["vcf_typed"].schema().simpleString() == "struct<pos:bigint,reference:binary,alternate:binary,quality:double,dp:bigint,af:double>"
    with pytest.raises(SpecError):
        Dialect(()).validate()
