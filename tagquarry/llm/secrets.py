"""Secrets in texts, and in what is encoded within them, layer by layer.

Fixed patterns find the base spans of a text. Then a worklist of layers is emptied: from
each layer come others, by undoing URL escapes, Unicode escapes (of scripts, and numeric
character references), base64 and, of the bytes that these give, compression (gzip, zlib,
bzip2, xz, zstandard). Each new layer is scanned with the same patterns, and its spans are
mapped back, layer by layer, to the code points of the text that they come from: through
escapes and base64 to the very characters, through compression to the whole stream. A layer
that equals one of those it comes from ends its branch (a stream can unpack to itself), and
one that other steps have already made of the same stretch of text isn't opened again. So
the list empties: all other steps shorten what they decode.

Of overlapping findings all are kept, base spans always; equal spans count once. Base64 is
what has at least SHORT characters of either alphabet, with padding or without, in lines or
not, and decodes to printable UTF-8 or to a compressed stream; as the run may begin within
other text, all four alignments are tried. A compressed stream that unpacks to more than
UNPACKED bytes is a bomb: it isn't opened, and counted in `unopened`, as are damaged ones.

One pass over the texts, without a shuffle; a task holds one batch of texts and the layers of
one. Null text counts as empty: no spans. Long texts are read whole, in time proportional to
length and to the number of layers. Repeated rows and null ids are rows like any other; an
empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

KINDS = ("assign", "access", "hex")
#: The fixed patterns. Runs that are too short for the last two can be skipped at once.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RUNS = (("access", re.compile("AKIA[A-Z0-9]{12,}")), ("hex", re.compile("[0-9a-f]{32,}")))
VALUE = 8
#: Least characters of base64; most bytes of an unpacked stream.
SHORT, UNPACKED = 16, 64 << 20

URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)*[A-Za-z0-9+/_-]{%d,}" % SHORT)
STANDARD = str.maketrans("-_", "+/", "\r\n")
UNPRINTABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: First bytes of compressed streams, and what unpacks them piece by piece.
STREAMS: tuple[tuple[bytes, Callable], ...] = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj), (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj),
    (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", lambda: __import__("zstandard").ZstdDecompressor().decompressobj()),
)

#: start, end, kind
Span = tuple[int, int, str]
#: From places of a layer to places of the layer before.
Places = Callable[[int, int], tuple[int, int]]


def scanned(text: str) -> Iterator[Span]:
    """The fixed patterns' matches."""
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= VALUE:
            yield m.start(), m.end(), "assign"
    for kind, pattern in RUNS:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind


class Opened:
    """A layer under construction: pieces of text, each from a stretch of the layer before."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []  # where each piece begins here
        self.low: list[int] = []
        self.high: list[int] = []
        self.alike: list[bool] = []  # whether a piece's characters are those before, one for one
        self.length = 0

    def add(self, part: str, low: int, high: int, alike: bool = False) -> None:
        if part:
            self.parts.append(part)
            self.at.append(self.length)
            self.low.append(low)
            self.high.append(high)
            self.alike.append(alike)
            self.length += len(part)

    def places(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low = self.low[i] + (start - self.at[i] if self.alike[i] else 0)
        return low, self.low[j] + end - self.at[j] if self.alike[j] else self.high[j]

    def layer(self) -> tuple[str, Places]:
        return "".join(self.parts), self.places


def characters(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Each character of UTF-8 with its bytes; a byte that is none is U+FFFD."""
    at = 0
    while at < len(raw):
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        one = raw[at : at + size].decode("utf-8", "replace")
        if len(one) != 1:
            one, size = "�", 1
        yield one, at, at + size
        at += size


def without_urls(text: str) -> tuple[str, Places]:
    out, at = Opened(), 0
    for m in URL.finditer(text):
        out.add(text[at : m.start()], at, m.start(), True)
        for c, low, high in characters(bytes.fromhex(m[0].replace("%", ""))):
            out.add(c, m.start() + 3 * low, m.start() + 3 * high)
        at = m.end()
    out.add(text[at:], at, len(text), True)
    return out.layer()


def units(escape: str) -> Iterator[tuple[int, int, int]]:
    """The code units of an escape, or of several of one form, with their places in it."""
    if escape.startswith("&#"):
        yield int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1]), 0, len(escape)
    elif escape.startswith("\\u{"):
        yield int(escape[3:-1], 16), 0, len(escape)
    else:
        size = {"u": 6, "x": 4, "U": 10}[escape[1]]
        for i in range(0, len(escape), size):
            yield int(escape[i + 2 : i + size], 16), i, i + size


def without_unicode(text: str) -> tuple[str, Places]:
    out, at = Opened(), 0
    for m in UNICODE.finditer(text):
        out.add(text[at : m.start()], at, m.start(), True)
        high_half = None
        for n, low, high in units(m[0]):
            if high_half is not None and 0xDC00 <= n < 0xE000:  # the second half of a pair
                out.add(chr(0x10000 + ((high_half[0] - 0xD800) << 10) + n - 0xDC00), m.start() + high_half[1], m.start() + high)
                high_half = None
                continue
            if high_half is not None:
                out.add("�", m.start() + high_half[1], m.start() + high_half[2])
            high_half = (n, low, high) if 0xD800 <= n < 0xDC00 else None
            if high_half is None:
                out.add("�" if n > 0x10FFFF or 0xDC00 <= n < 0xE000 else chr(n), m.start() + low, m.start() + high)
        if high_half is not None:
            out.add("�", m.start() + high_half[1], m.start() + high_half[2])
        at = m.end()
    out.add(text[at:], at, len(text), True)
    return out.layer()


def unpacked(raw: bytes) -> bytes | None:
    """What a compressed stream holds; None if these bytes begin none, or one that can't be opened."""
    for head, opener in STREAMS:
        if raw.startswith(head):
            stream, out, size = opener(), [], 0
            try:
                for at in range(0, len(raw), 1 << 12):
                    out.append(stream.decompress(raw[at : at + (1 << 12)]))
                    size += len(out[-1])
                    if size > UNPACKED:
                        return None
                    if getattr(stream, "eof", False):
                        break
            except Exception as e:  # each library has its own errors for damaged streams
                if isinstance(e, MemoryError):
                    raise
            return b"".join(out) or None
    return None


def compressed(raw: bytes) -> bool:
    return any(raw.startswith(head) for head, _ in STREAMS)


def printable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not UNPRINTABLE.search(text) else None


#: A layer: its text, or bytes that are a compressed stream, and where its places are in the text itself.
Layer = tuple[str | bytes, Places]


def bytes_layers(raw: bytes, stretch: tuple[int, int]) -> Iterator[Layer]:
    if compressed(raw):
        yield raw, lambda start, end: stretch


def base64_layers(text: str) -> Iterator[Layer]:
    for m in BASE64.finditer(text):
        # lines: characters that count, and their places
        places = range(m.start(), m.end()) if "\n" not in m[0] else [m.start() + i for i, c in enumerate(m[0]) if c not in "\r\n"]
        run = m[0].translate(STANDARD)
        for shift in range(4):
            part = run[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            if compressed(raw):
                yield from bytes_layers(raw, (places[shift], places[-1] + 1))
            elif (found := printable(raw)) is not None:
                out = Opened()
                for c, low, high in characters(raw):
                    out.add(c, places[shift + low * 4 // 3], places[min(shift + -(-high * 4 // 3), len(places)) - 1] + 1)
                yield found, out.places


def layers_of(value: str | bytes, count: Counter) -> Iterator[Layer]:
    """The layers directly within a layer, with places in it."""
    if isinstance(value, bytes):
        raw = unpacked(value)
        if raw is None:
            count["unopened"] += 1
        elif compressed(raw):
            yield raw, lambda start, end: (0, 1)
        elif (text := printable(raw)) is not None:
            yield text, lambda start, end: (0, 1)
        return
    if "%" in value and URL.search(value):
        yield without_urls(value)
        for m in URL.finditer(value):
            yield from bytes_layers(bytes.fromhex(m[0].replace("%", "")), m.span())
    if ("\\" in value or "&#" in value) and UNICODE.search(value):
        yield without_unicode(value)
        for m in UNICODE.finditer(value):
            if m[0].startswith("\\x"):
                yield from bytes_layers(bytes.fromhex(m[0].replace("\\x", "")), m.span())
    yield from base64_layers(value)


def digest(value: str | bytes) -> bytes:
    return hashlib.blake2b(value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass"), digest_size=16, person=b"bytes" if isinstance(value, bytes) else b"text").digest()


def all_spans(text: str | None) -> tuple[list[Span], list[Span], Counter]:
    """Base spans, all spans, both in order; and how many layers were opened, were cycles, or could not be opened."""
    text, count = text or "", Counter()
    base = sorted(scanned(text), key=order)
    found = set(base)
    seen: set[tuple[bytes, int, int]] = set()
    # layers still to be opened, with the way back to the text, and what they come from
    work: list[tuple[str | bytes, Places, tuple[bytes, ...]]] = [(text, lambda start, end: (start, end), ())]
    while work:
        value, back, above = work.pop()
        own = (*above, digest(value)) if above or "%" in value or "\\" in value or "&#" in value else above
        for inner, places in layers_of(value, count):
            own = own or (digest(value),)
            way = (lambda places, back: lambda start, end: back(*places(start, end)))(places, back)
            name = digest(inner)
            stretch = (name, way(0, 1)[0], way(len(inner) - 1, len(inner))[1])
            if name in own:
                count["cycles"] += 1
            if name in own or stretch in seen:
                continue
            seen.add(stretch)
            count["layers"] += 1
            if isinstance(inner, str):
                found.update((*way(start, end), kind) for start, end, kind in scanned(inner))
            work.append((inner, way, own))
    return base, sorted(found, key=order), count


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and spans, a list of (start, end, kind, base: whether the text itself shows it), with numbers of layers opened, cycles, and streams that could not be opened."""
    def run(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("spans", "layers", "cycles", "unopened")}
        for text in texts:
            base, every, count = all_spans(text)
            own = set(base)
            out["spans"].append([{"start": s[0], "end": s[1], "kind": s[2], "base": s in own} for s in every])
            for c in ("layers", "cycles", "unopened"):
                out[c].append(count[c])
        return out

    return map_texts(docs, keep, run, "spans array<struct<start:int,end:int,kind:string,base:boolean>>, layers int, cycles int, unopened int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long) as n_{k}" for k in KINDS]
    text = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return spans.selectExpr("doc_id", *counts, f"sha2({text.format('filter(spans, s -> s.base)')}, 256) as base_sha256", f"{text.format('spans')} as spans", "layers", "cycles", "unopened")
