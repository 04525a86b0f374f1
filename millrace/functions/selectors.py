"""CSS selectors matched while a page is read: no tree is built.

A selector group is compiled to its alternatives, each a list of compounds with the combinator in front of each. While tags
open and close, every open element carries, for each alternative, which of its compounds the element itself matches as the
end of a chain, and which any element of the stack does. A new element extends those chains: a child needs its parent's own,
a descendant anyone's. So a match is known when the tag opens.

Supported: tag, `*`, `.class`, `#id`, `[attr]`, `[attr=v]`, `[attr*=v]`, `[attr^=v]`, `[attr$=v]`, descendant and `>` combinators, commas.

An end tag closes the nearest open element of its name and all within it; without one it is ignored. Void elements never stay open.
At the end of the page everything closes. Comments, scripts, styles and templates give no text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MUTE = {"script", "style", "template"}
_PART = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]""")


@dataclass(frozen=True)
class Compound:
    tag: str | None
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None, str], ...]  # name, operator, value

    def fits(self, tag: str, attrs: dict[str, str], classes: set[str]) -> bool:
        if self.tag and self.tag != tag or not self.classes <= classes:
            return False
        return all(name in attrs and _holds(op, attrs[name], value) for name, op, value in self.attributes)


def _holds(op: str | None, there: str, value: str) -> bool:
    if op is None:
        return True
    if op == "=":
        return there == value
    return bool(value) and {"*=": value in there, "^=": there.startswith(value), "$=": there.endswith(value)}[op]


def _compound(text: str) -> Compound:
    tag, classes, attributes, at = None, set(), [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not a supported selector: {text!r}")
        at = m.end()
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["cls"]:
            classes.add(m["cls"])
        elif m["id"]:
            attributes.append(("id", "=", m["id"]))
        else:
            attributes.append((m["attr"].lower(), m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")))
    return Compound(tag, frozenset(classes), tuple(attributes))


def _split(text: str, at: str) -> list[str]:
    """At a separator outside brackets and quotes."""
    return re.findall(rf"""(?:\[(?:"[^"]*"|'[^']*'|[^\]])*\]|[^\[{at}])+""", text)


def compiled(group: str) -> list[list[tuple[str, Compound]]]:
    """The alternatives of a group, each as (combinator, compound) from the outermost on."""
    out = []
    for alternative in _split(group, ",") or [""]:
        chain, combinator = [], " "
        for word in _split(re.sub(r"\s*>\s*(?![^\[]*\])", " > ", alternative.strip()), r"\s"):
            if word == ">":
                combinator = ">"
            else:
                chain.append((combinator, _compound(word)))
                combinator = " "
        if not chain or combinator == ">":
            raise ValueError(f"not a supported selector: {group!r}")
        out.append(chain)
    return out


@dataclass(eq=False)
class Element:
    """An open element: its name, its attributes, and the bits of the chains that end at it (own) or at any element of the stack."""

    tag: str
    attrs: dict[str, str]
    own: tuple[int, ...] = ()
    any: tuple[int, ...] = ()
    state: int = 0  # the matcher's number of own and any
    notes: list = field(default_factory=list)  # what the reader hangs on it


#: Kinds of elements that a matcher remembers at most; then it begins anew.
KINDS = 20_000


class Matcher:
    """Several named groups at once. What an element matches depends on its parent's bits, its tag, its classes and what its other
    attributes hold of what is asked for: elements that are alike in these are settled once."""

    def __init__(self, groups: dict[str, str]):
        self.chains: list[tuple[str, list[tuple[str, Compound]]]] = [(name, chain) for name, group in groups.items() for chain in compiled(group)]
        asked = {test for _, chain in self.chains for _, compound in chain for test in compound.attributes}
        self.tests = sorted((t for t in asked if t[0] != "class"), key=str)
        self.kinds: dict[tuple, tuple] = {}
        self.states = 0

    def opened(self, element: Element, parent: Element | None) -> frozenset[str]:
        """Settles the element's bits; the names of the groups that it matches."""
        attrs = element.attrs
        holds = tuple([name in attrs and _holds(op, attrs[name], value) for name, op, value in self.tests]) if attrs else ()
        kind = (parent.state if parent else 0, element.tag, attrs.get("class"), holds)
        known = self.kinds.get(kind)
        if known is None:
            names = frozenset(self._settled(element, parent))
            if len(self.kinds) >= 2 * KINDS:
                self.kinds.clear()
            state = self.kinds.get((element.own, element.any))
            if state is None:
                self.states += 1  # numbers are never used again
                state = self.kinds[element.own, element.any] = self.states
            known = self.kinds[kind] = (element.own, element.any, state, names)
        element.own, element.any, element.state, names = known
        return names

    def _settled(self, element: Element, parent: Element | None) -> set[str]:
        classes = set(element.attrs.get("class", "").split())
        own, every, names = [], [], set()
        for n, (name, chain) in enumerate(self.chains):
            above_own, above_any = (parent.own[n], parent.any[n]) if parent else (0, 0)
            bits = 0
            for k, (combinator, compound) in enumerate(chain):
                reached = k == 0 or (above_own if combinator == ">" else above_any) >> (k - 1) & 1
                if reached and compound.fits(element.tag, element.attrs, classes):
                    bits |= 1 << k
            own.append(bits)
            every.append(above_any | bits)
            if bits >> (len(chain) - 1) & 1:
                names.add(name)
        element.own, element.any = tuple(own), tuple(every)
        return names


class Reader(HTMLParser):
    """Reads a page and tells a subclass what opens, closes and is said, with the groups that an element matches."""

    def __init__(self, matcher: Matcher):
        super().__init__(convert_charrefs=True)
        self.matcher, self.stack, self.mute = matcher, [], 0

    def opens(self, element: Element, names: set[str]) -> None: ...

    def closes(self, element: Element) -> None: ...

    def says(self, text: str) -> None: ...

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs})
        names = self.matcher.opened(element, self.stack[-1] if self.stack else None)
        self.stack.append(element)
        self.mute += tag in MUTE
        self.opens(element, names)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if tag not in VOID and any(e.tag == tag for e in self.stack):
            while self._close().tag != tag:
                pass

    def handle_data(self, data):
        if not self.mute:
            self.says(data)

    def _close(self) -> Element:
        element = self.stack.pop()
        self.mute -= element.tag in MUTE
        self.closes(element)
        return element

    def read(self, html: str) -> None:
        self.feed(html)
        self.close()
        while self.stack:
            self._close()
