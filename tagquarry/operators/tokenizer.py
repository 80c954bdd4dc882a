"""HTML text to tokens, in runs: one search or match for each run of text, name or value.

The caller pulls tokens and may change what comes next: `content` (the kind of text
that follows a start tag), `last_start`, and `foreign` (whether CDATA sections are read).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.entities import decode

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SPACE = "\t\n\f "
NAME = re.compile(r"[^\t\n\f />]+")
GAP = re.compile(r"[\t\n\f ]*")
ATTRIBUTE = re.compile(r"=?[^\t\n\f />=]*")
UNQUOTED = re.compile(r"[^\t\n\f >]*")
COMMENT_END = re.compile(r"--!?>")
SCRIPT = re.compile(r"<!--|-->|</?script(?=[\t\n\f />])", re.I)
RCDATA = frozenset(["title", "textarea"])
RAWTEXT = frozenset(["style", "xmp", "iframe", "noembed", "noframes"])


@dataclass(slots=True)
class Token:
    type: str  # start, end, text, comment, doctype, eof
    name: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    data: str | None = None
    self_closing: bool = False
    public: str | None = None
    system: str | None = None
    quirks: bool = False
    at: int = 0


def prepared(html: str | None, keep_bom: bool = False) -> str:
    text = html or ""
    if not keep_bom and text.startswith("\ufeff"):
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


XML_TEXT = re.compile("[\ufdd0-\ufdef" + "".join(chr(p << 16 | x) for p in range(17) for x in (0xFFFE, 0xFFFF)) + "]")


def xml_text(text: str) -> str:
    return XML_TEXT.sub("�", text.replace("\f", " "))


class Tokenizer:
    def __init__(self, html: str | None, *, keep_bom: bool = False, xml: bool = False, content: str = "data", last_start: str | None = None):
        self.text, self.at, self.xml = prepared(html, keep_bom), 0, xml
        self.content, self.last_start, self.foreign = content, last_start, False
        self.errors: list[tuple[str, int]] = []

    def error(self, code: str, at: int | None = None) -> None:
        self.errors.append((code, self.at if at is None else at))

    def place(self, at: int) -> tuple[int, int]:
        """Line and column, from 1."""
        at = min(at, len(self.text))
        return self.text.count("\n", 0, at) + 1, at - (self.text.rfind("\n", 0, at) + 1) + 1

    def next(self) -> Token:
        if self.at >= len(self.text):
            return Token("eof", at=self.at)
        if self.content == "data":
            return self._data()
        if self.content == "plaintext":
            return self._text(len(self.text), raw=True)
        return self._raw()

    def _text(self, end: int, raw: bool = False) -> Token:
        start, data = self.at, self.text[self.at : end]
        self.at = end
        if "\0" in data:
            self.error("unexpected-null-character", start + data.index("\0"))
            if self.content != "data":
                data = data.replace("\0", "�")
        if not raw:
            data = decode(data)
        return Token("text", data=xml_text(data) if self.xml else data, at=start)

    def _raw(self) -> Token:
        """Text up to the end tag that matches the last start tag, then that tag."""
        name = self.last_start or ""
        if self.content == "script":
            end = self._script_end()
        else:
            m = re.compile(f"</{re.escape(name)}(?=[\t\n\f />])", re.I).search(self.text, self.at) if name else None
            end = m.start() if m else len(self.text)
        if end > self.at:
            return self._text(end, raw=self.content != "rcdata")
        self.content = "data"
        return self._tag(2, "end")

    def _script_end(self) -> int:
        state, at = 0, self.at
        while m := SCRIPT.search(self.text, at):
            found, at = m[0].lower(), m.end()
            if found == "<!--":
                if state == 0:
                    state, at = 1, m.start() + 2  # the dashes may close it at once
            elif found == "-->":
                state = 0
            elif found == "<script":
                state = 2 if state == 1 else state
            elif state == 2:
                state = 1
            else:
                return m.start()
        return len(self.text)

    def _data(self) -> Token:
        text, at = self.text, self.at
        if text[at] != "<":
            end = text.find("<", at)
            return self._text(end if end >= 0 else len(text))
        after = text[at + 1 : at + 2]
        if after.isascii() and after.isalpha():
            return self._tag(1, "start")
        if after == "/":
            then = text[at + 2 : at + 3]
            if then.isascii() and then.isalpha():
                return self._tag(2, "end")
            if then == ">":
                self.error("missing-end-tag-name", at + 2)
                self.at = at + 3
                return self.next()
            if not then:
                self.error("eof-before-tag-name", at + 2)
                return self._text(len(text))
            self.error("invalid-first-character-of-tag-name", at + 2)
            return self._bogus(at + 2)
        if after == "!":
            return self._declaration()
        if after == "?":
            self.error("unexpected-question-mark-instead-of-tag-name", at + 1)
            return self._bogus(at + 1)
        self.error("invalid-first-character-of-tag-name" if after else "eof-before-tag-name", at + 1)
        end = text.find("<", at + 1)
        return self._text(end if end >= 0 else len(text))

    def _comment(self, data: str, end: int, start: int) -> Token:
        self.at = end
        data = data.replace("\0", "�")
        if self.xml:
            data = xml_text(data).replace("--", "- -")
            data = data + " " if data.endswith("-") else data
        return Token("comment", data=data, at=start)

    def _bogus(self, begin: int) -> Token:
        start, end = self.at, self.text.find(">", begin)
        return self._comment(self.text[begin : end if end >= 0 else None], end + 1 if end >= 0 else len(self.text), start)

    def _declaration(self) -> Token:
        text, at = self.text, self.at
        if text.startswith("--", at + 2):
            begin = at + 4
            for empty in (">", "->"):
                if text.startswith(empty, begin):
                    self.error("abrupt-closing-of-empty-comment", begin)
                    return self._comment("", begin + len(empty), at)
            m = COMMENT_END.search(text, begin)
            if not m:
                self.error("eof-in-comment", len(text))
                data = text[begin:]
                for tail in ("--!", "--", "-"):
                    if data.endswith(tail):
                        data = data[: -len(tail)]
                        break
                return self._comment(data, len(text), at)
            if m[0] == "--!>":
                self.error("incorrectly-closed-comment", m.start())
            data = text[begin : m.start()]
            if "<!--" in data:
                self.error("nested-comment", begin + data.index("<!--"))
            return self._comment(data, m.end(), at)
        if text[at + 2 : at + 9].lower() == "doctype":
            return self._doctype()
        if text.startswith("[CDATA[", at + 2):
            if self.foreign:
                end = text.find("]]>", at + 9)
                if end < 0:
                    self.error("eof-in-cdata", len(text))
                data = text[at + 9 : end if end >= 0 else None]
                self.at = end + 3 if end >= 0 else len(text)
                return Token("text", data=xml_text(data) if self.xml else data, at=at) if data else self.next()
            self.error("cdata-in-html-content", at + 2)
            return self._bogus(at + 2)
        self.error("incorrectly-opened-comment", at + 2)
        return self._bogus(at + 2)

    def _doctype(self) -> Token:
        text, start = self.text, self.at
        at = GAP.match(text, start + 9).end()
        if at == start + 9 and text[at : at + 1] not in (">", ""):
            self.error("missing-whitespace-before-doctype-name", at)
        token = Token("doctype", at=start)

        def done(end: int, quirks: bool) -> Token:
            token.quirks |= quirks
            close = text.find(">", end)
            if close < 0:
                self.error("eof-in-doctype", len(text))
                token.quirks = True
            self.at = close + 1 if close >= 0 else len(text)
            return token

        if text[at : at + 1] in (">", ""):
            if at < len(text):
                self.error("missing-doctype-name", at)
            return done(at, True)
        m = re.compile(r"[^\t\n\f >]+").match(text, at)
        token.name = m[0].translate(ASCII_LOWER).replace("\0", "�")
        at = GAP.match(text, m.end()).end()
        if text[at : at + 1] in (">", ""):
            return done(at, False)
        word = text[at : at + 6].lower()
        if word not in ("public", "system"):
            self.error("invalid-character-sequence-after-doctype-name", at)
            return done(at, True)

        def quoted(at: int) -> tuple[str | None, int, bool]:
            """Identifier, what follows, and whether it was closed by its quote."""
            at = GAP.match(text, at).end()
            if text[at : at + 1] not in ("'", '"') or at >= len(text):
                return None, at, False
            end = re.compile(f"[{text[at]}>]|$(?![\\s\\S])").search(text, at + 1).start()
            value = text[at + 1 : end].replace("\0", "�")
            return value, end + (text[end : end + 1] == text[at]), text[end : end + 1] == text[at]

        at += 6
        if word == "public":
            token.public, at, closed = quoted(at)
            if not closed:
                self.error("missing-doctype-public-identifier" if token.public is None else "abrupt-doctype-public-identifier", at)
                return done(at, True)
            at = GAP.match(text, at).end()
            if text[at : at + 1] in (">", ""):
                return done(at, False)
        token.system, at, closed = quoted(at)
        if not closed:
            self.error("missing-doctype-system-identifier" if token.system is None else "abrupt-doctype-system-identifier", at)
            return done(at, True)
        at = GAP.match(text, at).end()
        if text[at : at + 1] not in (">", ""):
            self.error("unexpected-character-after-doctype-system-identifier", at)
        return done(at, False)

    def _tag(self, skip: int, kind: str) -> Token:
        text, start = self.text, self.at
        m = NAME.match(text, start + skip)
        token = Token(kind, m[0].translate(ASCII_LOWER).replace("\0", "�"), {}, at=start)
        at = m.end()
        while True:
            at = GAP.match(text, at).end()
            c = text[at : at + 1]
            if not c:
                self.error("eof-in-tag", len(text))
                self.at = len(text)
                return Token("eof", at=self.at)
            if c == ">":
                break
            if c == "/":
                if text[at + 1 : at + 2] == ">":
                    token.self_closing, at = True, at + 1
                    break
                if at + 1 < len(text):
                    self.error("unexpected-solidus-in-tag", at + 1)
                at += 1
                continue
            at = self._attribute(token, at)
        self.at = at + 1
        if kind == "end":
            if token.attrs:
                self.error("end-tag-with-attributes", at)
            if token.self_closing:
                self.error("end-tag-with-trailing-solidus", at)
            return token
        self.last_start = token.name
        if not self.foreign:
            name = token.name
            if name in RCDATA:
                self.content = "rcdata"
            elif name in RAWTEXT:
                self.content = "rawtext"
            elif name in ("script", "plaintext"):
                self.content = name
        return token

    def _attribute(self, token: Token, at: int) -> int:
        text = self.text
        m = ATTRIBUTE.match(text, at)
        name = m[0].translate(ASCII_LOWER).replace("\0", "�")
        if name.startswith("="):
            self.error("unexpected-equals-sign-before-attribute-name", at)
        if '"' in name or "'" in name or "<" in name:
            self.error("unexpected-character-in-attribute-name", at)
        gap = GAP.match(text, m.end()).end()
        value, after = "", m.end()
        if text[gap : gap + 1] == "=":
            at = GAP.match(text, gap + 1).end()
            quote = text[at : at + 1]
            if quote in ("'", '"') and quote:
                end = text.find(quote, at + 1)
                if end < 0:
                    return len(text)
                value, after = text[at + 1 : end], end + 1
                if text[after : after + 1] not in ("\t", "\n", "\f", " ", "/", ">", ""):
                    self.error("missing-whitespace-between-attributes", after)
            elif quote == ">":
                self.error("missing-attribute-value", at)
                after = at
            else:
                m = UNQUOTED.match(text, at)
                value, after = m[0], m.end()
                if any(c in value for c in "\"'<=`"):
                    self.error("unexpected-character-in-unquoted-attribute-value", at)
            if after >= len(text):
                return len(text)
        if name in token.attrs:
            self.error("duplicate-attribute", after)
        else:
            token.attrs[name] = decode(value, True).replace("\0", "�") if "\0" in value or "&" in value else value
        return after
