"""Tokens to a tree, by the insertion modes of the HTML standard (scripting off).

Every walk is a loop, so depth is bounded by memory alone.
"""

from __future__ import annotations

from .tokenizer import SPACE, Token, Tokenizer

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MATH_TEXT = frozenset(["mi", "mo", "mn", "ms", "mtext"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset([("html", n) for n in "applet caption html table td th marquee object template".split()] + [("math", n) for n in "mi mo mn ms mtext annotation-xml".split()] + [("svg", n) for n in "foreignObject desc title".split()])
LIST_SCOPE = SCOPE | {("html", "ol"), ("html", "ul")}
BUTTON_SCOPE = SCOPE | {("html", "button")}
TABLE_SCOPE = frozenset(("html", n) for n in ("html", "table", "template"))
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IMPLIED_ALL = IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
CLOSED_BLOCK = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_TAGS = {
    n.lower(): n
    for n in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()
}
SVG_ATTRS = {
    n.lower(): n
    for n in "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()
}
# Fixed values of the standard: beginnings of public identifiers, lower case.
QUIRKY_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
QUIRKY_IDS = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKY_SYSTEM = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"
QUIRKY_WITHOUT_SYSTEM = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
LIMITED = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")


class Node:
    __slots__ = ("attrs", "children", "content", "data", "kind", "name", "ns", "parent")

    def __init__(self, kind: str, name: str, ns: str | None = None, attrs: dict | None = None, data=None):
        self.kind, self.name, self.ns, self.data = kind, name, ns, data
        self.attrs: dict[str, str] = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.content: Node | None = None

    def add(self, node: Node, before: Node | None = None) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
        node.parent = self
        if before is None:
            self.children.append(node)
        else:
            self.children.insert(self.children.index(before), node)


MARKER = Node("marker", "")


def quirks_of(token: Token, srcdoc: bool = False) -> str:
    public, system = (token.public or "").lower(), (token.system or "").lower()
    if srcdoc:
        return "quirks" if token.quirks else "no-quirks"
    if token.quirks or token.name != "html" or public in QUIRKY_IDS or system == QUIRKY_SYSTEM or public.startswith(QUIRKY_PREFIXES):
        return "quirks"
    if public.startswith(QUIRKY_WITHOUT_SYSTEM):
        return "limited-quirks" if token.system is not None else "quirks"
    return "limited-quirks" if public.startswith(LIMITED) else "no-quirks"


class Builder:
    def __init__(self, tokens: Tokenizer, fragment: tuple[str, str | None] | None = None, srcdoc: bool = False):
        self.tokens, self.srcdoc = tokens, srcdoc
        self.document = Node("document", "#document") if fragment is None else Node("fragment", "#document-fragment")
        self.open: list[Node] = []
        self.formatting: list[Node] = []
        self.modes: list = []  # of templates
        self.head = self.form = self.context = None
        self.frameset_ok, self.foster, self.skip_newline = True, False, False
        self.quirks, self.mode, self.back = "no-quirks", self.initial, None
        self.table_text: list[Token] = []
        self.errors: list[tuple[str, int]] = []
        if fragment is not None:
            name, ns = fragment
            self.context = Node("element", name if ns else name.lower(), ns or "html")
            root = self.element("html", "html")
            self.document.add(root)
            self.open.append(root)
            if name == "template" and not ns:
                self.modes.append(self.in_template)
            self.reset_mode()
            self.frameset_ok = False

    # -- stack

    @property
    def top(self) -> Node:
        return self.open[-1]

    def error(self, code: str, token: Token) -> None:
        self.errors.append((code, token.at))

    def element(self, name: str, ns: str, attrs: dict | None = None) -> Node:
        node = Node("element", name, ns, attrs)
        if name == "template" and ns == "html":
            node.content = Node("content", "#document-fragment")
        return node

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Where the next node goes: parent and the node it comes before."""
        target = target or self.top
        if self.foster and target.ns == "html" and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "table" and self.open[i].ns == "html"), None)
            template = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "template" and self.open[i].ns == "html"), None)
            if template is not None and (table is None or template > table):
                return self.open[template].content, None
            if table is None:
                return self.open[0], None
            if self.open[table].parent is not None:
                return self.open[table].parent, self.open[table]
            target = self.open[table - 1]
        return (target.content if target.content is not None else target), None

    def insert(self, token: Token, ns: str = "html") -> Node:
        node = self.element(token.name, ns, dict(token.attrs))
        parent, before = self.place()
        parent.add(node, before)
        self.open.append(node)
        return node

    def text(self, data: str) -> None:
        if not data:
            return
        parent, before = self.place()
        if parent.kind == "document":
            return
        at = parent.children.index(before) if before is not None else len(parent.children)
        if at and parent.children[at - 1].kind == "text":
            parent.children[at - 1].data += data
        else:
            parent.add(Node("text", "#text", data=data), before)

    def comment(self, token: Token, parent: Node | None = None) -> None:
        node, before = Node("comment", "#comment", data=token.data), None
        if parent is None:
            parent, before = self.place()
        parent.add(node, before)

    def in_scope(self, names, scope=SCOPE) -> bool:
        names = (names,) if isinstance(names, str) else names
        for node in reversed(self.open):
            if node.ns == "html" and node.name in names:
                return True
            if (node.ns, node.name) in scope:
                return False
        return False

    def in_select_scope(self, name: str) -> bool:
        for node in reversed(self.open):
            if node.name == name and node.ns == "html":
                return True
            if node.name not in ("optgroup", "option"):
                return False
        return False

    def pop_to(self, names) -> None:
        names = (names,) if isinstance(names, str) else names
        while self.open:
            node = self.open.pop()
            if node.ns == "html" and node.name in names:
                return

    def clear_to(self, names) -> None:
        while not (self.top.ns == "html" and self.top.name in names):
            self.open.pop()

    def implied(self, but: str | None = None, names=IMPLIED) -> None:
        while self.top.ns == "html" and self.top.name in names and self.top.name != but:
            self.open.pop()

    def has(self, name: str) -> bool:
        return any(n.name == name and n.ns == "html" for n in self.open)

    def close_p(self, token: Token) -> None:
        if self.in_scope("p", BUTTON_SCOPE):
            self.implied("p")
            if self.top.name != "p":
                self.error("expected-closing-tag-but-got-another", token)
            self.pop_to("p")

    # -- formatting

    def reconstruct(self) -> None:
        at = len(self.formatting) - 1
        if at < 0 or self.formatting[at] is MARKER or self.formatting[at] in self.open:
            return
        while at > 0 and self.formatting[at - 1] is not MARKER and self.formatting[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self.insert(Token("start", old.name, old.attrs))

    def remember(self, node: Node) -> None:
        same = 0
        for i in range(len(self.formatting) - 1, -1, -1):
            old = self.formatting[i]
            if old is MARKER:
                break
            if old.name == node.name and old.ns == node.ns and old.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.formatting[i]
                    break
        self.formatting.append(node)

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not MARKER:
            pass

    def adopt(self, token: Token) -> None:
        """The adoption agency."""
        name = token.name
        if self.top.name == name and self.top.ns == "html" and self.top not in self.formatting:
            self.open.pop()
            return
        for _ in range(8):
            subject = None
            for node in reversed(self.formatting):
                if node is MARKER:
                    break
                if node.name == name:
                    subject = node
                    break
            if subject is None:
                return self.any_other_end(token)
            if subject not in self.open:
                self.error("adoption-agency-1.3", token)
                self.formatting.remove(subject)
                return None
            at = self.open.index(subject)
            if not self.element_in_scope(subject):
                self.error("adoption-agency-1.3", token)
                return None
            if subject is not self.top:
                self.error("adoption-agency-1.3", token)
            block = next((n for n in self.open[at + 1 :] if self.special(n)), None)
            if block is None:
                del self.open[at:]
                self.formatting.remove(subject)
                return None
            ancestor, mark = self.open[at - 1], self.formatting.index(subject)
            last, place, inner = block, self.open.index(block), 0
            while True:
                inner += 1
                place -= 1
                node = self.open[place]
                if node is subject:
                    break
                if inner > 3 and node in self.formatting:
                    i = self.formatting.index(node)
                    del self.formatting[i]
                    mark -= i < mark
                if node not in self.formatting:
                    del self.open[place]
                    continue
                copy = self.element(node.name, "html", dict(node.attrs))
                self.formatting[self.formatting.index(node)] = copy
                self.open[place] = copy
                if last is block:
                    mark = self.formatting.index(copy) + 1
                copy.add(last)
                last = copy
            foster, self.foster = self.foster, True
            parent, before = self.place(ancestor)
            self.foster = foster
            parent.add(last, before)
            copy = self.element(subject.name, "html", dict(subject.attrs))
            for child in list(block.children):
                child.parent = copy
            copy.children, block.children = block.children, []
            block.add(copy)
            i = self.formatting.index(subject)
            del self.formatting[i]
            self.formatting.insert(mark - (i < mark), copy)
            self.open.remove(subject)
            self.open.insert(self.open.index(block) + 1, copy)
        return None

    def element_in_scope(self, wanted: Node) -> bool:
        for node in reversed(self.open):
            if node is wanted:
                return True
            if (node.ns, node.name) in SCOPE:
                return False
        return False

    @staticmethod
    def special(n: Node) -> bool:
        return n.name in SPECIAL if n.ns == "html" else (n.ns, n.name) in SCOPE

    def any_other_end(self, token: Token) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.ns == "html" and node.name == token.name:
                self.implied(token.name)
                if self.top is not node:
                    self.error("unexpected-end-tag", token)
                del self.open[self.open.index(node) :]
                return
            if self.special(node):
                self.error("unexpected-end-tag", token)
                return

    # -- running

    def run(self) -> Node:
        while True:
            token = self.tokens.next()
            if token.type == "doctype" and self.mode != self.initial:
                self.error("unexpected-doctype", token)
                continue
            if self.skip_newline:
                self.skip_newline = False
                if token.type == "text" and token.data.startswith("\n"):
                    token.data = token.data[1:]
            if token.type == "text" and self.in_math_text():
                # neither stands in the text of these
                token.data = token.data.replace("\0", "").replace("\f", "")
                if not token.data:
                    continue
            again = True
            while again:
                again = self.foreign(token) if self.is_foreign(token) else self.mode(token)
            top = self.open[-1] if self.open else None
            top = self.context if self.context is not None and len(self.open) == 1 else top
            self.tokens.foreign = top is not None and top.ns != "html"
            if token.type == "eof":
                break
        self.mirror_selected()
        if self.context is not None:
            root = self.document.children[0]
            self.document.children = root.children
            for c in root.children:
                c.parent = self.document
        return self.document

    def in_math_text(self) -> bool:
        return bool(self.open) and self.top.ns == "math" and self.top.name in MATH_TEXT

    def is_foreign(self, token: Token) -> bool:
        if not self.open or token.type == "eof":
            return False
        n = self.context if self.context is not None and len(self.open) == 1 else self.top
        if n.ns == "html":
            return False
        start = token.type == "start"
        if n.ns == "math" and n.name in MATH_TEXT and ((start and token.name not in ("mglyph", "malignmark")) or token.type == "text"):
            return False
        if n.ns == "math" and n.name == "annotation-xml" and start and token.name == "svg":
            return False
        return not (self.html_point(n) and (start or token.type == "text"))

    @staticmethod
    def html_point(n: Node) -> bool:
        if n.ns == "svg":
            return n.name in ("foreignObject", "desc", "title")
        return n.ns == "math" and n.name == "annotation-xml" and n.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")

    def foreign(self, t: Token) -> bool:
        if t.type == "text":
            if "\0" in t.data:
                t.data = t.data.replace("\0", "�")
            if t.data.strip(SPACE + "�"):
                self.frameset_ok = False
            self.text(t.data)
        elif t.type == "comment":
            self.comment(t)
        elif t.type == "start":
            if t.name in BREAKOUT or (t.name == "font" and {"color", "face", "size"} & t.attrs.keys()):
                self.error("unexpected-html-element-in-foreign-content", t)
                while len(self.open) > 1 and self.top.ns != "html" and not self.html_point(self.top) and not (self.top.ns == "math" and self.top.name in MATH_TEXT):
                    self.open.pop()
                self.tokens.foreign = False
                self.switch_content(t)
                return self.mode(t)
            n = self.context if self.context is not None and len(self.open) == 1 else self.top
            self.insert_foreign(t, n.ns)
        elif t.type == "end":
            if t.name in ("br", "p"):
                self.error("unexpected-html-element-in-foreign-content", t)
                while len(self.open) > 1 and self.top.ns != "html" and not self.html_point(self.top):
                    self.open.pop()
                return self.mode(t)
            for i in range(len(self.open) - 1, 0, -1):
                node = self.open[i]
                if node.ns == "html":
                    return self.mode(t)
                if node.name.lower() == t.name:
                    del self.open[i:]
                    break
                if i == len(self.open) - 1:
                    self.error("unexpected-end-tag", t)
        return False

    def switch_content(self, t: Token) -> None:
        """The text that follows a start tag read as foreign but put into HTML."""

    def insert_foreign(self, t: Token, ns: str) -> None:
        attrs = {}
        for k, v in t.attrs.items():
            if ns == "math" and k == "definitionurl":
                k = "definitionURL"
            elif ns == "svg":
                k = SVG_ATTRS.get(k, k)
            attrs[k] = v
        self.insert(Token("start", SVG_TAGS.get(t.name, t.name) if ns == "svg" else t.name, attrs), ns)
        if t.self_closing:
            self.open.pop()
        else:
            self.tokens.foreign = True
        self.tokens.content = "data"

    def reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            if last and self.context is not None:
                node = self.context
            name = node.name if node.ns == "html" else ""
            if self.context is node and name in ("select", "template", "head", "frameset"):
                self.mode = self.in_body
                return
            if name == "select":
                inside = any(n.name == "table" for n in self.open[:i]) and not any(n.name == "template" for n in self.open[:i])
                self.mode = self.in_select_in_table if inside else self.in_select
                return
            if name in ("td", "th") and not last:
                self.mode = self.in_cell
                return
            found = {"tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table, "body": self.in_body, "frameset": self.in_frameset}.get(name)
            if name == "template":
                found = self.modes[-1]
            elif name == "head" and not last:
                found = self.in_head
            elif name == "html" and self.context is None:
                found = self.before_head if self.head is None else self.after_head
            if found:
                self.mode = found
                return
            if last:
                self.mode = self.in_body
                return

    # -- modes: each returns whether the token is to be processed again

    @staticmethod
    def split(t: Token) -> tuple[str, str]:
        rest = t.data.lstrip(SPACE)
        return t.data[: len(t.data) - len(rest)], rest

    def initial(self, t: Token) -> bool:
        if t.type == "text":
            t.data = self.split(t)[1]
            if not t.data:
                return False
        elif t.type == "comment":
            self.comment(t, self.document)
            return False
        elif t.type == "doctype":
            self.document.add(Node("doctype", "!doctype", data=t))
            self.quirks, self.mode = quirks_of(t, self.srcdoc), self.before_html
            if t.name != "html" or t.public or (t.system and t.system != "about:legacy-compat"):
                self.error("unknown-doctype", t)
            return False
        if not self.srcdoc:
            self.error("expected-doctype-but-got-" + {"text": "chars", "start": "start-tag", "end": "end-tag"}.get(t.type, "eof"), t)
            self.quirks = "quirks"
        self.mode = self.before_html
        return True

    def before_html(self, t: Token) -> bool:
        if t.type == "comment":
            self.comment(t, self.document)
            return False
        if t.type == "text":
            t.data = self.split(t)[1]
            if not t.data:
                return False
        if t.type == "end" and t.name not in ("head", "body", "html", "br"):
            self.error("unexpected-end-tag-before-html", t)
            return False
        attrs = dict(t.attrs) if t.type == "start" and t.name == "html" else {}
        root = self.element("html", "html", attrs)
        self.document.add(root)
        self.open.append(root)
        self.mode = self.before_head
        return not (t.type == "start" and t.name == "html")

    def before_head(self, t: Token) -> bool:
        if t.type == "text":
            t.data = self.split(t)[1]
            if not t.data:
                return False
        elif t.type == "comment":
            self.comment(t)
            return False
        elif t.type == "start" and t.name == "html":
            return self.in_body(t)
        elif t.type == "end" and t.name not in ("head", "body", "html", "br"):
            self.error("unexpected-end-tag", t)
            return False
        own = t.type == "start" and t.name == "head"
        self.head = self.insert(t if own else Token("start", "head"))
        self.mode = self.in_head
        return not own

    def raw(self, t: Token) -> None:
        self.insert(t)
        self.back, self.mode = self.mode, self.in_text

    def in_head(self, t: Token) -> bool:
        if t.type == "text":
            space, t.data = self.split(t)
            self.text(space)
            if not t.data:
                return False
        elif t.type == "comment":
            self.comment(t)
            return False
        elif t.type == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert(t)
                self.open.pop()
                return False
            if t.name in ("title", "style", "noframes", "script"):
                self.raw(t)
                return False
            if t.name == "noscript":
                self.insert(t)
                self.mode = self.in_head_noscript
                return False
            if t.name == "template":
                self.insert(t)
                self.formatting.append(MARKER)
                self.frameset_ok = False
                self.mode = self.in_template
                self.modes.append(self.in_template)
                return False
            if t.name == "head":
                self.error("unexpected-start-tag", t)
                return False
        elif t.type == "end":
            if t.name == "template":
                self.end_template(t)
                return False
            if t.name not in ("head", "body", "html", "br"):
                self.error("unexpected-end-tag", t)
                return False
        self.open.pop()
        self.mode = self.after_head
        return not (t.type == "end" and t.name == "head")

    def end_template(self, t: Token) -> None:
        if not self.has("template"):
            self.error("unexpected-end-tag", t)
            return
        self.implied(names=IMPLIED_ALL)
        if self.top.name != "template":
            self.error("unexpected-end-tag", t)
        self.pop_to("template")
        self.clear_formatting()
        self.modes.pop()
        self.reset_mode()

    def in_head_noscript(self, t: Token) -> bool:
        if t.type == "start" and t.name == "html":
            return self.in_body(t)
        if t.type == "end" and t.name == "noscript":
            self.open.pop()
            self.mode = self.in_head
            return False
        if t.type == "comment" or (t.type == "start" and t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            return self.in_head(t)
        if t.type == "text":
            space, t.data = self.split(t)
            self.text(space)
            if not t.data:
                return False
        elif (t.type == "start" and t.name in ("head", "noscript")) or (t.type == "end" and t.name != "br"):
            self.error("unexpected-token-in-noscript", t)
            return False
        self.error("unexpected-token-in-noscript", t)
        self.open.pop()
        self.mode = self.in_head
        return True

    def after_head(self, t: Token) -> bool:
        if t.type == "text":
            space, t.data = self.split(t)
            self.text(space)
            if not t.data:
                return False
        elif t.type == "comment":
            self.comment(t)
            return False
        elif t.type == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name in ("body", "frameset"):
                self.insert(t)
                self.frameset_ok &= t.name != "body"
                self.mode = self.in_body if t.name == "body" else self.in_frameset
                return False
            if t.name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.error("unexpected-start-tag", t)
                self.open.append(self.head)
                back = self.mode
                self.mode = self.in_head
                self.in_head(t)
                if self.mode == self.in_text:
                    self.back = back
                elif self.mode == self.in_head:
                    self.mode = back
                self.open.remove(self.head)
                return False
            if t.name == "head":
                self.error("unexpected-start-tag", t)
                return False
        elif t.type == "end":
            if t.name == "template":
                self.end_template(t)
                return False
            if t.name not in ("body", "html", "br"):
                self.error("unexpected-end-tag", t)
                return False
        self.insert(Token("start", "body"))
        self.mode = self.in_body
        return True

    def in_text(self, t: Token) -> bool:
        if t.type == "text":
            self.text(t.data)
            return False
        self.mode = self.back
        if t.type == "eof":
            self.error("expected-named-closing-tag-but-got-eof", t)
            self.open.pop()
            return True
        self.open.pop()
        return False

    def in_body(self, t: Token) -> bool:
        if t.type == "text":
            data = t.data.replace("\0", "")
            if data:
                self.reconstruct()
                self.text(data)
                if data.strip(SPACE):
                    self.frameset_ok = False
            return False
        if t.type == "comment":
            self.comment(t)
            return False
        if t.type == "eof":
            if self.modes:
                return self.in_template(t)
            if any(n.name not in ("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html") for n in self.open):
                self.error("expected-closing-tag-but-got-eof", t)
            return False
        return self.body_start(t) if t.type == "start" else self.body_end(t)

    def body_start(self, t: Token) -> bool:
        name = t.name
        if name == "html":
            self.error("non-html-root", t)
            if not self.has("template") and self.open:
                for k, v in t.attrs.items():
                    self.open[0].attrs.setdefault(k, v)
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            back = self.mode
            again = self.in_head(t)
            if self.mode == self.in_text:
                self.back = back
            return again
        elif name == "body":
            self.error("unexpected-start-tag", t)
            if len(self.open) > 1 and self.open[1].name == "body" and not self.has("template"):
                self.frameset_ok = False
                for k, v in t.attrs.items():
                    self.open[1].attrs.setdefault(k, v)
        elif name == "frameset":
            self.error("unexpected-start-tag", t)
            if len(self.open) > 1 and self.open[1].name == "body" and self.frameset_ok:
                self.open[1].parent.children.remove(self.open[1])
                self.open[1].parent = None
                del self.open[1:]
                self.insert(t)
                self.mode = self.in_frameset
        elif name in CLOSE_P:
            self.close_p(t)
            self.insert(t)
        elif name in HEADINGS:
            self.close_p(t)
            if self.top.ns == "html" and self.top.name in HEADINGS:
                self.error("unexpected-start-tag", t)
                self.open.pop()
            self.insert(t)
        elif name in ("pre", "listing"):
            self.close_p(t)
            self.insert(t)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "form":
            if self.form is not None and not self.has("template"):
                self.error("unexpected-start-tag", t)
            else:
                self.close_p(t)
                node = self.insert(t)
                if not self.has("template"):
                    self.form = node
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            wanted = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.ns == "html" and node.name in wanted:
                    self.implied(node.name)
                    self.pop_to(node.name)
                    break
                if self.special(node) and node.name not in ("address", "div", "p"):
                    break
            self.close_p(t)
            self.insert(t)
        elif name == "plaintext":
            self.close_p(t)
            self.insert(t)
        elif name == "button":
            if self.in_scope("button"):
                self.error("unexpected-start-tag-implies-end-tag", t)
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.insert(t)
            self.frameset_ok = False
        elif name == "a":
            for node in reversed(self.formatting):
                if node is MARKER:
                    break
                if node.name == "a":
                    self.error("unexpected-start-tag-implies-end-tag", t)
                    self.adopt(t)
                    if node in self.formatting:
                        self.formatting.remove(node)
                    if node in self.open:
                        self.open.remove(node)
                    break
            self.reconstruct()
            self.remember(self.insert(t))
        elif name in FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.in_scope("nobr"):
                self.error("unexpected-start-tag-implies-end-tag", t)
                self.adopt(t)
                self.reconstruct()
            self.remember(self.insert(t))
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(t)
            self.formatting.append(MARKER)
            self.frameset_ok = False
        elif name == "table":
            if self.quirks != "quirks":
                self.close_p(t)
            self.insert(t)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input", "image"):
            if name == "image":
                self.error("image-start-tag", t)
                t.name = "img"
            self.reconstruct()
            self.insert(t)
            self.open.pop()
            if not (name == "input" and t.attrs.get("type", "").lower() == "hidden"):
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.insert(t)
            self.open.pop()
        elif name == "hr":
            self.close_p(t)
            self.insert(t)
            self.open.pop()
            self.frameset_ok = False
        elif name == "textarea":
            self.raw(t)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "xmp":
            self.close_p(t)
            self.reconstruct()
            self.frameset_ok = False
            self.raw(t)
        elif name in ("iframe", "noembed"):
            self.frameset_ok &= name != "iframe"
            self.raw(t)
        elif name == "select":
            self.reconstruct()
            self.insert(t)
            self.frameset_ok = False
            inside = self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell)
            self.mode = self.in_select_in_table if inside else self.in_select
        elif name in ("optgroup", "option"):
            if self.top.name == "option":
                self.open.pop()
            self.reconstruct()
            self.insert(t)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied("rtc" if name in ("rp", "rt") else None)
            self.insert(t)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.insert_foreign(t, name)
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error("unexpected-start-tag-ignored", t)
        else:
            self.reconstruct()
            self.insert(t)
        if t.self_closing and name not in VOID and name not in ("math", "svg", "image", "basefont", "bgsound", "frame", "keygen"):
            self.error("non-void-html-element-start-tag-with-trailing-solidus", t)
        return False

    def body_end(self, t: Token) -> bool:
        name = t.name
        if name == "template":
            self.end_template(t)
        elif name in ("body", "html"):
            if not self.in_scope("body"):
                self.error("unexpected-end-tag", t)
                return False
            if any(n.name not in ("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html") for n in self.open):
                self.error("expected-one-end-tag-but-got-another", t)
            self.mode = self.after_body
            return name == "html"
        elif name in CLOSED_BLOCK:
            if not self.in_scope(name):
                self.error("unexpected-end-tag", t)
                return False
            self.implied()
            if self.top.name != name:
                self.error("end-tag-too-early", t)
            self.pop_to(name)
        elif name == "form":
            if not self.has("template"):
                node, self.form = self.form, None
                if node is None or not self.element_in_scope(node):
                    self.error("unexpected-end-tag", t)
                    return False
                self.implied()
                if self.top is not node:
                    self.error("end-tag-too-early", t)
                self.open.remove(node)
            elif self.in_scope("form"):
                self.implied()
                self.pop_to("form")
            else:
                self.error("unexpected-end-tag", t)
        elif name == "p":
            if not self.in_scope("p", BUTTON_SCOPE):
                self.error("unexpected-end-tag", t)
                self.insert(Token("start", "p"))
            self.close_p(t)
        elif name in ("li", "dd", "dt"):
            if not self.in_scope(name, LIST_SCOPE if name == "li" else SCOPE):
                self.error("unexpected-end-tag", t)
                return False
            self.implied(name)
            if self.top.name != name:
                self.error("end-tag-too-early", t)
            self.pop_to(name)
        elif name in HEADINGS:
            if not self.in_scope(HEADINGS):
                self.error("unexpected-end-tag", t)
                return False
            self.implied()
            if self.top.name != name:
                self.error("end-tag-too-early", t)
            self.pop_to(HEADINGS)
        elif name in FORMATTING:
            self.adopt(t)
        elif name in ("applet", "marquee", "object"):
            if not self.in_scope(name):
                self.error("unexpected-end-tag", t)
                return False
            self.implied()
            self.pop_to(name)
            self.clear_formatting()
        elif name == "br":
            self.error("unexpected-end-tag-treated-as", t)
            return self.body_start(Token("start", "br", at=t.at))
        else:
            self.any_other_end(t)
        return False

    def in_table(self, t: Token) -> bool:
        if t.type == "text" and self.top.name in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.table_text, self.back_table = [], self.mode
            self.mode = self.in_table_text
            return True
        if t.type == "comment":
            self.comment(t)
            return False
        if t.type == "eof":
            return self.in_body(t)
        name = t.name
        if t.type == "start":
            if name in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to(("table", "template", "html"))
                if name == "caption":
                    self.formatting.append(MARKER)
                    self.insert(t)
                    self.mode = self.in_caption
                elif name in ("colgroup", "col"):
                    self.insert(t if name == "colgroup" else Token("start", "colgroup"))
                    self.mode = self.in_column_group
                    return name == "col"
                else:
                    own = name in ("tbody", "tfoot", "thead")
                    self.insert(t if own else Token("start", "tbody"))
                    self.mode = self.in_table_body
                    return not own
                return False
            if name == "table":
                self.error("unexpected-start-tag-implies-end-tag", t)
                if not self.in_scope("table", TABLE_SCOPE):
                    return False
                self.pop_to("table")
                self.reset_mode()
                return True
            if name in ("style", "script", "template"):
                back = self.mode
                self.in_head(t)
                if self.mode == self.in_text:
                    self.back = back
                return False
            if name == "input" and t.attrs.get("type", "").lower() == "hidden":
                self.error("unexpected-hidden-input-in-table", t)
                self.insert(t)
                self.open.pop()
                return False
            if name == "form":
                self.error("unexpected-form-in-table", t)
                if not self.has("template") and self.form is None:
                    self.form = self.insert(t)
                    self.open.pop()
                return False
        elif t.type == "end":
            if name == "table":
                if not self.in_scope("table", TABLE_SCOPE):
                    self.error("unexpected-end-tag", t)
                    return False
                self.pop_to("table")
                self.reset_mode()
                return False
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                self.error("unexpected-end-tag", t)
                return False
            if name == "template":
                self.end_template(t)
                return False
        self.error("unexpected-implied-end-tag-in-table-view" if t.type == "end" else "foster-parenting-start-tag", t)
        self.foster = True
        again = self.in_body(t)
        self.foster = False
        return again

    def in_table_text(self, t: Token) -> bool:
        if t.type == "text":
            if "\f" in t.data:
                self.error("invalid-codepoint-in-table-text", t)
            t.data = t.data.replace("\0", "").replace("\f", "")
            self.table_text.append(t)
            return False
        data = "".join(x.data for x in self.table_text)
        if data.strip(SPACE):
            self.error("foster-parenting-character", t)
            self.foster = True
            self.reconstruct()
            self.text(data)
            self.foster, self.frameset_ok = False, False
        else:
            self.text(data)
        self.mode = self.back_table
        return True

    def in_caption(self, t: Token) -> bool:
        ends = t.type == "end" and t.name in ("caption", "table")
        starts = t.type == "start" and t.name in ("caption", "col", "colgroup", "table", "tbody", "td", "tfoot", "th", "thead", "tr")
        if ends or starts:
            if not self.in_scope("caption", TABLE_SCOPE):
                self.error("unexpected-end-tag", t)
                return False
            self.implied()
            self.pop_to("caption")
            self.clear_formatting()
            self.mode = self.in_table
            return t.name != "caption" or starts
        if t.type == "end" and t.name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error("unexpected-end-tag", t)
            return False
        return self.in_body(t)

    def in_column_group(self, t: Token) -> bool:
        if t.type == "text":
            space, t.data = self.split(t)
            self.text(space)
            if not t.data:
                return False
        elif t.type == "comment":
            self.comment(t)
            return False
        elif t.type == "eof":
            return self.in_body(t)
        elif t.type == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name == "col":
                self.insert(t)
                self.open.pop()
                return False
            if t.name == "template":
                return self.in_head(t)
        elif t.name == "template":
            self.end_template(t)
            return False
        elif t.name == "col":
            self.error("no-end-tag", t)
            return False
        if self.top.name != "colgroup":
            self.error("unexpected-token-in-column-group", t)
            return False
        self.open.pop()
        self.mode = self.in_table
        return not (t.type == "end" and t.name == "colgroup")

    def in_table_body(self, t: Token) -> bool:
        groups, name = ("tbody", "tfoot", "thead"), t.name
        if t.type == "start" and name in ("tr", "th", "td"):
            self.clear_to((*groups, "template", "html"))
            self.insert(t if name == "tr" else Token("start", "tr"))
            self.mode = self.in_row
            return name != "tr"
        if t.type == "end" and name in groups:
            if not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag", t)
                return False
            self.clear_to((*groups, "template", "html"))
            self.open.pop()
            self.mode = self.in_table
            return False
        if (t.type == "start" and name in ("caption", "col", "colgroup", *groups)) or (t.type == "end" and name == "table"):
            if not self.in_scope(groups, TABLE_SCOPE):
                self.error("unexpected-start-tag", t)
                return False
            self.clear_to((*groups, "template", "html"))
            self.open.pop()
            self.mode = self.in_table
            return True
        if t.type == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self.error("unexpected-end-tag", t)
            return False
        return self.in_table(t)

    def in_row(self, t: Token) -> bool:
        groups, name = ("tbody", "tfoot", "thead"), t.name
        if t.type == "start" and name in ("td", "th"):
            self.clear_to(("tr", "template", "html"))
            self.insert(t)
            self.mode = self.in_cell
            self.formatting.append(MARKER)
            return False
        out = (t.type == "start" and name in ("caption", "col", "colgroup", *groups, "tr")) or (t.type == "end" and name in ("tr", "table", *groups))
        if out:
            if t.type == "end" and name in groups and not self.in_scope(name, TABLE_SCOPE):
                self.error("unexpected-end-tag", t)
                return False
            if not self.in_scope("tr", TABLE_SCOPE):
                self.error("unexpected-end-tag", t)
                return False
            self.clear_to(("tr", "template", "html"))
            self.open.pop()
            self.mode = self.in_table_body
            return not (t.type == "end" and name == "tr")
        if t.type == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self.error("unexpected-end-tag", t)
            return False
        return self.in_table(t)

    def close_cell(self, t: Token) -> None:
        self.implied()
        if self.top.name not in ("td", "th"):
            self.error("unexpected-cell-end-tag", t)
        self.pop_to(("td", "th"))
        self.clear_formatting()
        self.mode = self.in_row

    def in_cell(self, t: Token) -> bool:
        name = t.name
        if t.type == "end":
            if name in ("td", "th"):
                if not self.in_scope(name, TABLE_SCOPE):
                    self.error("unexpected-end-tag", t)
                    return False
                self.implied()
                if self.top.name != name:
                    self.error("unexpected-cell-end-tag", t)
                self.pop_to(name)
                self.clear_formatting()
                self.mode = self.in_row
                return False
            if name in ("body", "caption", "col", "colgroup", "html"):
                self.error("unexpected-end-tag", t)
                return False
            if name in ("table", "tbody", "tfoot", "thead", "tr"):
                if not self.in_scope(name, TABLE_SCOPE):
                    self.error("unexpected-end-tag", t)
                    return False
                self.close_cell(t)
                return True
        elif t.type == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if not self.in_scope(("td", "th"), TABLE_SCOPE):
                self.error("unexpected-start-tag", t)
                return False
            self.close_cell(t)
            return True
        return self.in_body(t)

    def in_select(self, t: Token) -> bool:
        name = t.name
        if t.type == "text":
            self.reconstruct()
            self.text(t.data.replace("\0", "").replace("\f", ""))
        elif t.type == "comment":
            self.comment(t)
        elif t.type == "eof":
            return self.in_body(t)
        elif t.type == "start":
            if name == "html":
                return self.in_body(t)
            if name in ("option", "optgroup", "hr"):
                if self.top.name == "option":
                    self.open.pop()
                if name != "option" and self.top.name == "optgroup":
                    self.open.pop()
                self.insert(t)
                if name == "hr":
                    self.open.pop()
            elif name == "select":
                self.error("unexpected-select-in-select", t)
                self.pop_to("select")
                self.reset_mode()
            elif name in ("input", "keygen", "textarea"):
                self.error("unexpected-input-in-select", t)
                self.tokens.content = "data"
                if self.has("select"):
                    self.pop_to("select")
                    self.reset_mode()
                    if name == "textarea":
                        self.tokens.content = "rcdata"
                    return True
            elif name in ("script", "template"):
                back = self.mode
                self.in_head(t)
                if self.mode == self.in_text:
                    self.back = back
            elif name in ("svg", "math"):
                self.insert_foreign(t, name)
            elif name in ("p", "div", "span", "button", "datalist", "selectedcontent") or name in FORMATTING:
                self.reconstruct()
                node = self.insert(t)
                if name in FORMATTING:
                    self.remember(node)
            elif name in ("br", "img", "menuitem", "plaintext"):
                self.reconstruct()
                self.insert(t)
                if name in ("br", "img"):
                    self.open.pop()
                self.tokens.content = "plaintext" if name == "plaintext" else "data"
            else:
                self.error("unexpected-start-tag-in-select", t)
                self.tokens.content = "data"
        elif name == "optgroup":
            if self.top.name == "option" and len(self.open) > 1 and self.open[-2].name == "optgroup":
                self.open.pop()
            if self.top.name == "optgroup":
                self.open.pop()
        elif name == "option":
            if self.top.name == "option":
                self.open.pop()
        elif name == "select":
            if self.has("select"):
                self.pop_to("select")
                self.reset_mode()
        elif name == "template":
            self.end_template(t)
        elif name in FORMATTING:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "select"), -1)
            if any(n.name == name for n in self.open[at + 1 :]):
                self.adopt(t)
        elif name in ("p", "div", "span", "button", "datalist", "selectedcontent"):
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "select"), -1)
            if any(n.name == name for n in self.open[at + 1 :]):
                self.pop_to(name)
        else:
            self.error("unexpected-end-tag-in-select", t)
        return False

    def in_select_in_table(self, t: Token) -> bool:
        if t.type in ("start", "end") and t.name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.error("unexpected-table-element-in-select", t)
            if t.type == "end" and not self.in_scope(t.name, TABLE_SCOPE):
                return False
            self.pop_to("select")
            self.reset_mode()
            return True
        return self.in_select(t)

    def in_template(self, t: Token) -> bool:
        if t.type in ("text", "comment"):
            return self.in_body(t)
        if t.type == "eof":
            if not self.has("template"):
                return False
            self.error("expected-closing-tag-but-got-eof", t)
            self.pop_to("template")
            self.clear_formatting()
            self.modes.pop()
            self.reset_mode()
            return True
        if t.type == "end":
            if t.name == "template":
                self.end_template(t)
            else:
                self.error("unexpected-end-tag", t)
            return False
        if t.name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            back = self.mode
            self.in_head(t)
            if self.mode == self.in_text:
                self.back = back
            return False
        mode = self.in_body
        if t.name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
            mode = self.in_table
        elif t.name == "col":
            mode = self.in_column_group
        elif t.name == "tr":
            mode = self.in_table_body
        elif t.name in ("td", "th"):
            mode = self.in_row
        if self.modes:
            self.modes[-1] = mode
        self.mode = mode
        return True

    def after_body(self, t: Token) -> bool:
        if t.type == "comment":
            self.comment(t, self.open[0])
            return False
        if t.type == "text" and not t.data.strip(SPACE) or (t.type == "start" and t.name == "html"):
            return self.in_body(t)
        if t.type == "end" and t.name == "html":
            if self.context is None:
                self.mode = self.after_after_body
            return False
        if t.type == "eof":
            return False
        self.error("unexpected-token-after-body", t)
        self.mode = self.in_body
        return True

    def after_after_body(self, t: Token) -> bool:
        if t.type == "comment":
            self.comment(t, self.document)
            return False
        if t.type == "text" and not t.data.strip(SPACE) or (t.type == "start" and t.name == "html"):
            return self.in_body(t)
        if t.type == "eof":
            return False
        self.error("unexpected-token-after-body", t)
        self.mode = self.in_body
        return True

    def in_frameset(self, t: Token) -> bool:
        if t.type == "text":
            self.text("".join(c for c in t.data if c in SPACE))
        elif t.type == "comment":
            self.comment(t)
        elif t.type == "start" and t.name == "html":
            self.mode = self.in_body  # where a further frameset is not taken
            return True
        elif t.type == "start" and t.name in ("frameset", "frame"):
            self.insert(t)
            if t.name == "frame":
                self.open.pop()
        elif t.type == "start" and t.name == "noframes":
            return self.in_head(t)
        elif t.type == "end" and t.name == "frameset":
            if len(self.open) > 1:
                self.open.pop()
                if self.context is None and self.top.name != "frameset":
                    self.mode = self.after_frameset
        elif t.type != "eof":
            self.error("unexpected-token-in-frameset", t)
        return False

    def after_frameset(self, t: Token) -> bool:
        if t.type == "text":
            self.text("".join(c for c in t.data if c in SPACE))
        elif t.type == "comment":
            self.comment(t)
        elif t.type == "start" and t.name == "html":
            return self.in_body(t)
        elif t.type == "start" and t.name == "noframes":
            return self.in_head(t)
        elif t.type == "end" and t.name == "html":
            self.mode = self.after_after_frameset
        elif t.type != "eof":
            self.error("unexpected-token-after-frameset", t)
        return False

    def after_after_frameset(self, t: Token) -> bool:
        if t.type == "comment":
            self.comment(t, self.document)
        elif t.type == "text":
            self.text("".join(c for c in t.data if c in SPACE))
        elif t.type == "start" and t.name == "html":
            return self.in_body(t)
        elif t.type == "start" and t.name == "noframes":
            return self.in_head(t)
        return False

    def mirror_selected(self) -> None:
        """Puts a copy of the chosen option's content into a select's empty selectedcontent."""
        selects, todo = [], [self.document]
        while todo:
            n = todo.pop()
            if n.name == "select" and n.ns == "html":
                selects.append(n)
            todo += n.children
        for s in selects:
            inside, todo = [], list(reversed(s.children))
            while todo:
                n = todo.pop()
                inside.append(n)
                todo += reversed(n.children)
            target = next((n for n in inside if n.name == "selectedcontent" and n.ns == "html"), None)
            options = [n for n in inside if n.name == "option" and n.ns == "html"]
            if target is None or not options or target.children:
                continue
            option = next((o for o in options if "selected" in o.attrs), options[0])
            work = [(c, target) for c in option.children]
            for node, parent in work:
                copy = Node(node.kind, node.name, node.ns, dict(node.attrs), node.data)
                parent.add(copy)
                work += [(c, copy) for c in node.children]


def parse(html: str | None, *, fragment: tuple[str, str | None] | None = None, srcdoc: bool = False, xml: bool = False, keep_bom: bool = False) -> tuple[Node, Builder]:
    content = "data"
    if fragment and not fragment[1]:
        name = fragment[0].lower()
        content = "rawtext" if name in ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes") else "plaintext" if name in ("script", "plaintext") else "data"
    tokens = Tokenizer(html, keep_bom=keep_bom, xml=xml, content=content, last_start=fragment[0].lower() if fragment else None)
    builder = Builder(tokens, fragment, srcdoc)
    tokens.foreign = bool(fragment and fragment[1])
    return builder.run(), builder
