"""Bytes to text by column expressions: the rules of encoding.py as SQL over a binary column, so that documents decode in the JVM.

Bytes are looked at as ISO-8859-1, a character a byte. What no expression decodes (EUC-JP, and UTF-16 with lone surrogates
or an odd byte) goes through Python alone. Null bytes have neither text nor encoding; empty ones are empty windows-1252.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .encoding import HARD_LIMIT, LABELS, PRESCAN, decoded_as

_WS = r"\t\n\f\r "
_ATTRIBUTE = rf"[{_WS}/]*([^{_WS}/>=]+)(?:[{_WS}]*=[{_WS}]*(?:\"([^\"]*)\"|'([^']*)'|([^{_WS}>]*)))?"
_TAG = rf"<(/?[A-Za-z][^{_WS}/>]*)((?>{_ATTRIBUTE})*+)"
_CHARSET = rf"(?s)\A(?>.*?(?i:charset))[{_WS}]*=[{_WS}]*(?:\"([^\"]*)\"|'([^']*)'|([^{_WS};\"'][^{_WS};]*))"
#: White space of a label, as Python strips it from text that was bytes.
_AROUND = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"
#: A unit or a pair of UTF-16 as it should be, low byte first or high byte first, or else (group 1) one that is not.
_UNITS = {"le": r"(?s).[\xd8-\xdb].[\xdc-\xdf]|.[^\xd8-\xdf]|(..?)", "be": r"(?s)[\xd8-\xdb].[\xdc-\xdf].|[^\xd8-\xdf].|(..?)"}
#: Encodings of one byte a character beyond ISO-8859-1.
SINGLE = ("windows-1252", "iso-8859-2")


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """A value that is computed once and looked at several times."""
    return f"transform(array({value}), {name} -> {body})[0]"


def latin(content: str) -> str:
    return f"decode({content}, 'ISO-8859-1')"


def normalized(label: str) -> str:
    labels = ", ".join(f"{text(k)}, {text(v)}" for k, v in LABELS.items())
    return f"try_element_at(map({labels}), {_label(label)})"


def _label(label: str) -> str:
    return f"lower(regexp_replace({label}, {text(_AROUND)}, ''))"


def declared(label: str) -> str:
    name = normalized("d")
    return let("d", label, f"case when startswith({_label('d')}, 'utf-32') or startswith({_label('d')}, 'utf32') or startswith({name}, 'utf-16') then 'utf-8' else {name} end")


def _groups(value: str, pattern: str, first: int) -> str:
    """The one of three groups that has been found, or null."""
    return "nullif(" + " || ".join(f"regexp_extract({value}, {text(pattern)}, {first + i})" for i in range(3)) + ", '')"


def prescan(content: str) -> str:
    """The first encoding that a meta element declares in the first bytes that are no comment."""
    bare = f"regexp_replace({latin(f'substr({content}, 1, {HARD_LIMIT})')}, '(?s)<!--.*?-->', '')"
    head = f"left(substring_index({bare}, '<!--', 1), {PRESCAN})"
    metas = f"filter(regexp_extract_all({head}, {text(_TAG)}, 0), m -> lower(regexp_extract(m, {text(_TAG)}, 1)) = 'meta')"
    attributes = f"regexp_extract_all(regexp_extract(m, {text(_TAG)}, 2), {text(_ATTRIBUTE)}, 0)"

    def value(name: str) -> str:
        return _groups(f"get(filter(found, a -> lower(regexp_extract(a, {text(_ATTRIBUTE)}, 1)) = '{name}'), 0)", _ATTRIBUTE, 2)

    by_content = f"case when lower({value('http-equiv')}) = 'content-type' then {declared(_groups(value('content'), _CHARSET, 1))} end"
    each = let("found", attributes, f"coalesce({declared(value('charset'))}, {by_content})")
    return f"get(filter(transform({metas}, m -> {each}), e -> e is not null), 0)"


def sniffed(content: str, transport: str = "cast(null as string)") -> str:
    """SQL for struct<encoding, skip> of bytes: the label that came with them, their mark, their declaration, windows-1252. transport: SQL of the label."""
    marks = "".join(f" when startswith({content}, X'{mark}') then named_struct('encoding', '{name}', 'skip', {len(mark) // 2})" for mark, name in (("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be")))
    labelled = f"when {normalized(transport)} is not null then named_struct('encoding', {normalized(transport)}, 'skip', 0)"
    return f"case when {content} is null then null {labelled}{marks} else named_struct('encoding', coalesce({prescan(content)}, 'windows-1252'), 'skip', 0) end"


def _single(name: str) -> tuple[str, str]:
    """The characters of bytes from 0x80 on that are others than in ISO-8859-1, and what they are; undefined ones stay."""
    high = [(chr(b), bytes([b]).decode(name, "ignore")) for b in range(0x80, 0x100)]
    pairs = [(a, b) for a, b in high if b and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decoded(content: str, encoding: str) -> str:
    """SQL for the text of bytes without their mark, or null if only Python can tell."""
    out = f"when {encoding} = 'utf-8' then make_valid_utf8(cast({content} as string))"
    for name in SINGLE:
        old, new = _single(name)
        out += f" when {encoding} = '{name}' then translate({latin(content)}, {text(old)}, {text(new)})"
    for order in ("le", "be"):
        good = f"regexp_replace({latin('c')}, {text(_UNITS[order])}, '$1') = ''"
        mine = {"le": f"({encoding} = 'utf-16le' or {encoding} = 'utf-16' and not startswith({content}, X'FEFF'))", "be": f"({encoding} = 'utf-16be' or {encoding} = 'utf-16')"}[order]
        bare = f"case when {encoding} = 'utf-16' and (startswith({content}, X'FFFE') or startswith({content}, X'FEFF')) then substr({content}, 3) else {content} end"
        out += f" when {mine} then {let('c', bare, f"case when {good} then decode(c, 'UTF-16{order.upper()}') end")}"
    return f"case {out} end"


@F.pandas_udf(StringType())
def _rest(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else decoded_as(c, e) for c, e in zip(content, encoding)], dtype=object)


def with_text(docs: DataFrame, column: str, out: str, transport: str = "cast(null as string)", python: bool = True) -> DataFrame:
    """docs with a struct<text, encoding, rest> of a binary column. Without python, what no expression decodes has no text, and its bytes are in `rest`."""
    content, told = f"`{column}`", f"`{out}`"
    once = docs.select("*", F.explode(F.expr(f"array({sniffed(content, transport)})")).alias(out))
    bare = f"substr({content}, {told}.skip + 1)"
    made = let("made", decoded(bare, f"{told}.encoding"), f"named_struct('text', made, 'encoding', {told}.encoding, 'rest', case when made is null then {bare} end)")
    once = once.select("*", F.explode(F.expr(f"array({made})")).alias("__text")).drop(out).withColumnRenamed("__text", out)
    if not python:
        return once
    text = F.coalesce(F.col(f"{told}.text"), _rest(F.col(f"{told}.rest"), F.col(f"{told}.encoding")))
    return once.withColumn(out, F.struct(text.alias("text"), F.col(f"{told}.encoding").alias("encoding"), F.lit(None).cast("binary").alias("rest")))
