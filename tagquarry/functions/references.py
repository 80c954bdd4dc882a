"""Character references as a SQL expression: no Python while a query runs.

A text is cut at its ampersands. What follows one is a number, or a name: the longest prefix
that stands in the table of names wins. The table is an array of small maps, found by a sum
of a name's first characters and length, so a look-up compares a few names; only names that
need no semicolon, none of which is long, can be prefixes of what stands there.
"""

from __future__ import annotations

from html.entities import html5

from ..plans.folds import let
from .entities import C1

BUCKETS = 1024
LEGACY = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)


def bucket(name: str) -> int:
    codes = [ord(c) for c in (name[:1], name[1:2], name[2:3]) if c]
    codes += [0] * (3 - len(codes))
    return (codes[0] * 31 + codes[1] * 57 + codes[2] * 101 + len(name) * 7) % BUCKETS


def place(name: str) -> str:
    """bucket() in SQL."""
    return f"(ascii({name}) * 31 + ascii(substr({name}, 2)) * 57 + ascii(substr({name}, 3)) * 101 + length({name}) * 7) % {BUCKETS}"


def literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in text) + "'"


def table() -> str:
    found: list[list[str]] = [[] for _ in range(BUCKETS)]
    for name, value in html5.items():
        found[bucket(name)] += [f"'{name}'", literal(value)]
    return "array(" + ", ".join(f"map({', '.join(x)})" if x else "map('', '')" for x in found) + ")"


def looked_up(name: str) -> str:
    return f"try_element_at(names[{place(name)}], {name})"


def character(number: str) -> str:
    """The character of a code point; surrogates and what is none are U+FFFD, controls what the standard says."""
    controls = ", ".join(f"{n}, {literal(c)}" for n, c in sorted(C1.items()))
    return f"""case when {number} is null or {number} > 1114111 or {number} between 55296 and 57343 then '\\ufffd'
        else coalesce(try_element_at(map({controls}), {number}), decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')) end"""


def number(digits: str, base: int) -> str:
    """Null for more digits than any code point has."""
    return let([("d", f"trim(leading '0' from {digits})")], f"if(length(d) > 8, null, cast(conv(concat('0', d), {base}, 10) as int))")


def numeric(pattern: str, base: int) -> str:
    digits = f"regexp_extract(p, '{pattern}', 1)"
    rest = f"substr(p, length(regexp_extract(p, '{pattern}', 0)) + 1)"
    return f"concat({let([('n', number(digits, base))], character('n'))}, {rest})"


def unescaped(text: str, attribute: bool = False) -> str:
    """text with its references replaced. attribute: a name without a semicolon stands as it is before what could belong to it."""
    # the longest name with a semicolon is all of what stands there
    lengths = f"filter(array({', '.join(map(str, LEGACY))}), n -> n <= length(w) and {looked_up('left(w, n)')} is not null)"
    keeps = "rlike(substr(p, n + 1), '^[A-Za-z0-9=]')" if attribute else "false"
    legacy = let([("n", f"get({lengths}, 0)")], f"if(n is null or {keeps}, concat('&', p), concat({looked_up('left(w, n)')}, substr(p, n + 1)))")
    named = let([("w", "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;?', 0)"), ("full", f"if(endswith(w, ';'), {looked_up('w')}, null)")], f"if(full is not null, concat(full, substr(p, length(w) + 1)), {legacy})")
    one = f"""case when rlike(p, '^[A-Za-z]') then {named} when rlike(p, '^#[xX][0-9a-fA-F]') then {numeric('^#[xX]([0-9a-fA-F]+);?', 16)}
        when rlike(p, '^#[0-9]') then {numeric('^#([0-9]+);?', 10)} else concat('&', p) end"""
    parts = f"split({text}, '&', -1)"
    whole = let([("names", table()), ("parts", parts)], f"concat(parts[0], array_join(transform(slice(parts, 2, size(parts)), p -> {one}), ''))")
    return f"if(contains({text}, '&'), {whole}, {text})"
