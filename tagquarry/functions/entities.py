"""Character references: numeric, named, and the special rule for attribute values."""

from __future__ import annotations

import re
from html.entities import html5

#: Fixed values of the HTML standard: what numeric references to C1 controls stand for.
C1 = {
    0x00: "�", 0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*;?))")
LONGEST = max(map(len, html5))


def numeric(digits: str, base: int) -> str:
    digits = digits.lstrip("0") or "0"
    n = int(digits, base) if len(digits) <= 8 else 0x110000  # more digits than any code point has
    if n in C1:
        return C1[n]
    return "�" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def decode(text: str, attribute: bool = False) -> str:
    """text with its references replaced by what they stand for."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return numeric(m[1], 16)
        if m[2]:
            return numeric(m[2], 10)
        name = m[3]
        for n in range(min(len(name), LONGEST), 1, -1):
            if found := html5.get(name[:n]):
                if attribute and name[n - 1] != ";":
                    after = name[n : n + 1] or text[m.end() : m.end() + 1]
                    if after == "=" or (after.isascii() and after.isalnum()):
                        return m[0]
                return found + name[n:]
        return m[0]

    return REFERENCE.sub(one, text)
