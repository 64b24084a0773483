"""A small HTML reader: elements, text pieces, block texts and a selector matcher.

It reads markup in one pass over a token pattern and keeps going on broken
markup: an unknown end tag is ignored, an unclosed element ends with its
parent, and a tag that is cut off at the end of the page is dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

_HIDDEN_PART = r"<(script|style|template|title)\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>(.*?)(?:</\1\s*>|\Z)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|" + _HIDDEN_PART + r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CUT = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")

# Fixed values of HTML: void elements, and inline elements that leave a block's text together.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a b i em strong code span kbd".split())

#: An opening tag ends these open elements, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}
_ENDS_P = frozenset("p div ul ol dl table pre blockquote section article aside header footer nav main h1 h2 h3 h4 h5 h6 hr form".split())


class Page:
    """Elements in document order (parallel lists) and the text pieces between tags.

    ``pieces`` are (element, block, text): the element that holds the text, and
    a block number that grows at every block-level tag (-1 for a title, which
    is not shown).
    """

    def __init__(self, html: str):
        self.tags: list[str] = ["#page"]
        self.raw: list[str] = [""]
        self.parent: list[int] = [-1]
        self.pieces: list[tuple[int, int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, raw, parent, pieces = self.tags, self.raw, self.parent, self.pieces
        here, block, last = 0, 0, 0
        for m in _TOKEN.finditer(html):
            hidden, hidden_raw, body, slash, name, rest = m.groups()
            start, end = m.span()
            if start > last:
                pieces.append((here, block, html[last:start]))
            last = end
            if hidden is not None:
                tags.append(hidden.lower()), raw.append(hidden_raw), parent.append(here)
                block += 1
                if tags[-1] == "title":  # can be selected, but is in no block
                    pieces.append((len(tags) - 1, -1, body))
                continue
            if name is None:
                continue
            tag = name.lower()
            if tag == "br":
                pieces.append((here, block, "\n"))
                continue
            if tag not in INLINE:
                block += 1
            if slash:
                at = here
                while at > 0 and tags[at] != tag:
                    at = parent[at]
                if at > 0:
                    here = parent[at]
                continue
            if tag in _CLOSES:
                here = self._close(here, *_CLOSES[tag])
            elif tag in _ENDS_P and tags[here] == "p":
                here = parent[here]
            tags.append(tag)
            raw.append(rest)
            parent.append(here)
            if tag not in VOID and not rest.endswith("/"):
                here = len(tags) - 1
        if last < len(html):
            rest = html[last:]
            cut = _CUT.search(rest)
            pieces.append((here, block, rest[: cut.start()] if cut else rest))

    def _close(self, here: int, ends: set[str], within: set[str]) -> int:
        at = here
        while at > 0 and self.tags[at] not in within:
            if self.tags[at] in ends:
                return self._close(self.parent[at], ends, within)
            at = self.parent[at]
        return here

    def attributes(self, element: int) -> dict[str, str]:
        return attributes(self.raw[element])

    def path(self, element: int) -> list[int]:
        """The element and its ancestors, innermost first, without the page itself."""
        out = []
        while element > 0:
            out.append(element)
            element = self.parent[element]
        return out

    def blocks(self) -> list[tuple[int, int, str]]:
        """(element, block number, raw text with entities decoded) of every block that shows something."""
        out: list[tuple[int, int, str]] = []
        at, parts, element = -1, "", 0
        for el, block, text in self.pieces:
            if block < 0:
                continue
            if block != at:
                if parts and not parts.isspace():
                    out.append((element, at, unescape(parts) if "&" in parts else parts))
                at, parts, element = block, "", el
            elif parts.isspace():
                element = el
            parts += text
        if parts and not parts.isspace():
            out.append((element, at, unescape(parts) if "&" in parts else parts))
        return out

_BLOCK_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|" + _HIDDEN_PART + r"|</?(?!(?:a|b|i|em|strong|code|span|kbd|br)[\s/>])[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>",
    re.S | re.I,
)
_INLINE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[!?][^>]*>")


def block_texts(html: str) -> list[str]:
    """The texts of :meth:`Page.blocks` without their elements, by two substitutions."""
    marked = _BLOCK_TAG.sub(lambda m: "" if m.group().startswith("<!--") else "\0", html)
    cut = marked.rfind("<")
    if cut >= 0 and ">" not in marked[cut:] and _CUT.match(marked, cut):
        marked = marked[:cut]
    plain = _INLINE_TAG.sub(lambda m: "\n" if (m.group(2) or "").lower() == "br" else "", marked)
    return [unescape(t) if "&" in t else t for t in plain.split("\0") if t and not t.isspace()]


@lru_cache(maxsize=4096)
def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    return out


def fold(text: str) -> str:
    """White space of any kind as single blanks, trimmed."""
    return " ".join(text.split())


_STEP = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\s\"'\]]+))?\s*\]"
)
_PARTS = re.compile(r"\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[])+")

Step = tuple[bool, tuple[tuple[str, str, str], ...]]


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The alternatives of a selector, each as steps from the outermost: (child of the step before, tests).

    Knows tags, classes, ids, attributes (present, =, ~=, ^=, $=, *=), lists,
    and the descendant and child combinators; raises ``ValueError`` otherwise.
    """
    return tuple(_compile(one.strip(), selector) for one in re.findall(r"(?:\[[^\]]*\]|[^,\[])+|(?<=,)(?=,)", selector) or [""])


def _compile(text: str, selector: str) -> tuple[Step, ...]:
    steps: list[Step] = []
    child, open_ = False, False
    for part in _PARTS.findall(text):
        if not part.strip() or part.strip() == ">":
            child, open_ = child or ">" in part, True
            continue
        tests, at = [], 0
        while at < len(part):
            m = _STEP.match(part, at)
            if not m or m.group("tag") and at:
                raise ValueError(f"selector not understood: {selector!r}")
            if m.group("attr"):
                tests.append((m.group("op") or "has", m.group("attr").lower(), (m.group("val") or "").strip("\"'")))
            elif m.group("tag"):
                if m.group() != "*":
                    tests.append(("tag", m.group("tag").lower(), ""))
            else:
                tests.append(("cls" if m.group("cls") else "id", m.group("cls") or m.group("id"), ""))
            at = m.end()
        if child and not steps:
            raise ValueError(f"selector not understood: {selector!r}")
        steps.append((child, tuple(tests)))
        child, open_ = False, False
    if not steps or child or open_:
        raise ValueError(f"selector not understood: {selector!r}")
    return tuple(steps)


def _passes(page: Page, element: int, tests: tuple[tuple[str, str, str], ...]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            if page.tags[element] != name:
                return False
            continue
        attrs = page.attributes(element)
        if kind == "cls":
            ok = name in attrs.get("class", "").split()
        elif kind == "id":
            ok = attrs.get("id") == name
        else:
            held = attrs.get(name)
            ok = held is not None and (
                kind == "has"
                or kind == "=" and held == value
                or kind == "~=" and value in held.split()
                or kind == "^=" and bool(value) and held.startswith(value)
                or kind == "$=" and bool(value) and held.endswith(value)
                or kind == "*=" and bool(value) and value in held
            )
        if not ok:
            return False
    return True


def _matches(page: Page, element: int, steps: tuple[Step, ...]) -> bool:
    """Whether an element matches the last step and its ancestors the steps before."""
    child, tests = steps[-1]
    if not _passes(page, element, tests):
        return False
    if len(steps) == 1:
        return True
    above = page.parent[element]
    while above > 0:
        if _matches(page, above, steps[:-1]):
            return True
        if child:
            return False
        above = page.parent[above]
    return False


def select(page: Page, selector: str) -> list[int]:
    """Elements that a selector matches, in document order."""
    alternatives = compile_selector(selector)
    return [e for e in range(1, len(page.tags)) if any(_matches(page, e, steps) for steps in alternatives)]


def select_known(page: Page, selector: str) -> list[int]:
    """As :func:`select`; a selector that is not understood fits nothing, so that one bad rule does not end a job over all pages."""
    try:
        return select(page, selector)
    except ValueError:
        return []
