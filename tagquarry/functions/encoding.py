"""Bytes to text: byte order mark, transport label, declaration in the markup, decoding."""

from __future__ import annotations

import re

#: Labels and the encodings they stand for (UTF-7 is never honoured).
LABELS = {
    "utf-8": "utf-8", "utf8": "utf-8",
    "utf-7": "windows-1252", "utf7": "windows-1252", "x-utf-7": "windows-1252",
    "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252", "l1": "windows-1252", "cp819": "windows-1252", "ibm819": "windows-1252",
    "windows-1252": "windows-1252", "windows1252": "windows-1252", "cp1252": "windows-1252", "x-cp1252": "windows-1252",
    "iso-8859-2": "iso-8859-2", "iso8859-2": "iso-8859-2", "latin2": "iso-8859-2", "latin-2": "iso-8859-2",
    "euc-jp": "euc-jp", "eucjp": "euc-jp",
    "utf-16": "utf-16", "utf16": "utf-16", "utf-16le": "utf-16le", "utf16le": "utf-16le", "utf-16be": "utf-16be", "utf16be": "utf-16be",
}
PRESCAN, HARD_LIMIT = 1024, 65536
SPACES = b"\t\n\x0c\r "
ATTRIBUTE = re.compile(rb"[\t\n\x0c\r /]*([^\t\n\x0c\r />=][^\t\n\x0c\r />=]*)(?:[\t\n\x0c\r ]*=[\t\n\x0c\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\x0c\r >]*)))?")
COMMENT = re.compile(rb"<!--.*?-->", re.S)


def normalized(label: str | None) -> str | None:
    return LABELS.get(label.strip().lower()) if label else None


def declared(label: str | None) -> str | None:
    """A declaration in markup that could be read cannot be in UTF-16."""
    name = normalized(label)
    return "utf-8" if name and name.startswith("utf-16") or label and label.strip().lower().startswith(("utf-32", "utf32")) else name


def bom(content: bytes) -> tuple[str | None, int]:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if content.startswith(mark):
            return name, len(mark)
    return None, 0


def charset_in(content: str) -> str | None:
    """The charset of a content attribute."""
    m = re.search(r"charset", content, re.I)
    if not m or not (rest := re.match(r"[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r ;\"'][^\t\n\f\r ;]*))", content[m.end() :])):
        return None
    return rest[1] or rest[2] or rest[3]


def prescan(content: bytes) -> str | None:
    """The first encoding that a meta element declares in the first PRESCAN bytes that are no comment."""
    head = COMMENT.sub(b"", content[:HARD_LIMIT])
    if (at := head.find(b"<!--")) >= 0:
        head = head[:at]
    head, at = head[:PRESCAN], 0
    while (at := head.find(b"<", at)) >= 0:
        m = re.compile(rb"<(/?)([A-Za-z][^\t\n\x0c\r />]*)").match(head, at)
        if not m:
            at += 1
            continue
        at, found = m.end(), {}
        while (a := ATTRIBUTE.match(head, at)) and a.end() > at:
            found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or b"")
            at = a.end()
        if m[1] or m[2].lower() != b"meta":
            continue
        if name := declared(found.get(b"charset", b"").decode("latin-1")):
            return name
        if found.get(b"http-equiv", b"").lower() == b"content-type" and (name := declared(charset_in(found.get(b"content", b"").decode("latin-1")))):
            return name
    return None


def sniffed(content: bytes, transport: str | None = None) -> tuple[str, int]:
    """Encoding and bytes of the mark to skip: transport, then mark, then declaration, then windows-1252."""
    if name := normalized(transport):
        return name, 0
    name, skip = bom(content)
    return (name, skip) if name else (prescan(content) or "windows-1252", 0)


def decode(content: bytes, transport: str | None = None) -> tuple[str, str]:
    """Text and encoding."""
    name, skip = sniffed(content, transport)
    return decoded_as(content[skip:], name), name


def decoded_as(content: bytes, name: str) -> str:
    """Bytes that windows-1252 doesn't define become C1 controls, all else U+FFFD."""
    if name == "windows-1252":
        try:
            return content.decode("cp1252")
        except UnicodeDecodeError:
            return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in content)
    return content.decode(name, "replace")
