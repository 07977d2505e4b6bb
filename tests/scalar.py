"""A plain reading of the formats, one character at a time, that tests compare with."""

import re


def structurals(text, dialect):
    """Positions of live structural characters."""
    out, quoted, comment, run = [], False, False, 0
    for i, c in enumerate(text):
        starts = i == 0 or text[i - 1] == "\n"
        if not quoted and not comment and starts and c == dialect.comment:
            comment = True
        if comment:
            if c == "\n":
                comment = False
                if c in dialect.structural:
                    out.append(i)
            run = 0
            continue
        escaped = run % 2 == 1
        run = run + 1 if dialect.backslash and c == dialect.escape_char else 0
        if c == dialect.quote and not escaped:
            quoted = not quoted
        elif c in dialect.structural and not quoted:
            out.append(i)
    return out


def records(text, dialect):
    """Raw records, each a list of raw fields."""
    out, fields, at = [], [], 0
    begun = 0
    for i in structurals(text, dialect):
        if text[i] == "\n":
            line = text[begun:i]
            if not (dialect.comment and line.startswith(dialect.comment)):
                out.append([*fields, text[at:i]])
            fields, at, begun = [], i + 1, i + 1
        else:
            fields.append(text[at:i])
            at = i + 1
    rest = text[begun:]
    if rest and not (dialect.comment and rest.startswith(dialect.comment)):
        out.append([*fields, text[at:]])
    for r in out:
        if r[-1].endswith("\r"):
            r[-1] = r[-1][:-1]
    return out


def clean(x, dialect):
    q = dialect.quote
    outer = bool(q) and len(x) >= 2 and x[0] == x[-1] == q
    body = x[1:-1] if outer else x
    if dialect.backslash:
        return re.sub(r"(?s)" + re.escape(dialect.escape_char) + "(.)", r"\1", body)
    return body.replace(q * 2, q) if outer else x


def nesting(text, dialect):
    """(pairs, error, pos): matched bracket positions, and the first error."""
    pairs, stack = {}, []
    kinds = dict(dialect.nesting)
    for i in structurals(text, dialect):
        c = text[i]
        if c in kinds:
            stack.append(i)
        elif c in kinds.values():
            if not stack or kinds[text[stack[-1]]] != c:
                return pairs, "UnmatchedClose", i
            j = stack.pop()
            pairs[i], pairs[j] = j, i
    return (pairs, "UnclosedOpen", stack[-1]) if stack else (pairs, None, None)


def scalars(text, dialect):
    cuts = [-1, *structurals(text, dialect), len(text)]
    parts = [text[a + 1 : b].strip(" \t\r\n") for a, b in zip(cuts, cuts[1:])]
    return [p for p in parts if p]


def raws(text, dialect):
    """Raw records."""
    out, begun = [], 0
    for i in [*(i for i in structurals(text, dialect) if text[i] == "\n"), len(text)]:
        line = text[begun:i]
        if (i < len(text) or line) and not (dialect.comment and line.startswith(dialect.comment)):
            out.append(line.removesuffix("\r"))
        begun = i + 1
    return out
