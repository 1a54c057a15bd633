"""Leaf text blocks of an HTML page with the tags and names around them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Elements whose content is no markup; without an end tag they run to the end of the page.
RAW = frozenset("script style noscript title iframe".split())
#: Other elements whose content is no text of the page, if they are closed within their parent.
#: The controls of forms are among them, also outside of a form.
SKIPPED = frozenset("template svg math object canvas audio video button datalist label select textarea".split())
#: Those of them that may be empty elements, as may the raw ones within them.
FOREIGN = frozenset("svg math".split())

#: Elements that stand within a line of text; all other known ones end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li link main menu "
    "meta nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr "
    "ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements nested deeper than this are read as siblings, as browsers do.
DEPTH = 512

#: A start tag closes these open elements, up to the nearest of the boundary ones.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(sorted(RAW))})(?=[\s/>])[^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_MARK = re.compile(r"\bdata-main\b", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Element:
    """An open element: its tag and the words of its class, id and role."""

    tag: str
    names: tuple[str, ...] = ()
    marked: bool = False


@dataclass
class Block:
    """Text between two block boundaries, below ``path`` from the root down."""

    path: tuple[Element, ...]
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    links: int = 0
    text: str = ""


def _element(tag: str, attributes: str) -> Element:
    if not attributes.strip():
        return Element(tag)
    names = [p for m in _NAMES.finditer(attributes) for p in _PART.findall(m[m.lastindex].lower())]
    return Element(tag, tuple(dict.fromkeys(names)), _MARK.search(attributes) is not None)


@dataclass(frozen=True)
class Skip:
    """An open element of ``SKIPPED`` and what there was before it, to go back to at its end tag."""

    tag: str
    depth: int
    blocks: int
    current: Block | None
    parts: int
    link_chars: int
    links: int
    anchors: int


def _close(stack: list[Element], tags: tuple[str, ...], stop: tuple[str, ...], floor: int) -> None:
    for at in range(len(stack) - 1, floor - 1, -1):
        if stack[at].tag in stop:
            return
        if stack[at].tag in tags:
            del stack[at:]
            return


def _tokens(page: str, skips: list[Skip]) -> Iterator[re.Match]:
    """The tokens of a page but for raw elements, which are passed over."""
    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        raw = token["raw"]
        if raw is None:
            yield token
        elif not (token[0].endswith("/>") and any(s.tag in FOREIGN for s in skips)):
            end = _RAW_END[raw.lower()].search(page, at)
            at = end.end() if end else len(page)


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's non-blank blocks in order, with references decoded and white space folded.

    What stands in a closed element of ``SKIPPED`` is left out; one that is not
    closed before its parent is, or at all, leaves out nothing.
    """
    stack: list[Element] = []
    skips: list[Skip] = []
    blocks: list[Block] = []
    current: Block | None = None
    anchors = 0
    for token in _tokens(page or "", skips):
        text = token["text"]
        if text is not None:
            if current is None:
                if text.isspace():
                    continue
                current = Block(tuple(stack))
                blocks.append(current)
            current.parts.append(text)
            if anchors:
                current.link_chars += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if current is not None:
                current.parts.append("\n")
            continue
        if tag in SKIPPED:
            if not token["end"]:
                empty = tag in FOREIGN and token["attrs"].endswith("/")
                if not empty and len(skips) < DEPTH:
                    was = (len(current.parts), current.link_chars, current.links) if current else (0, 0, 0)
                    skips.append(Skip(tag, len(stack), len(blocks), current, *was, anchors))
                continue
            at = next((i for i in range(len(skips) - 1, -1, -1) if skips[i].tag == tag), None)
            if at is not None:
                skip = skips[at]
                del skips[at:], stack[skip.depth :], blocks[skip.blocks :]
                current, anchors = skip.current, skip.anchors
                if current is not None:
                    del current.parts[skip.parts :]
                    current.link_chars, current.links = skip.link_chars, skip.links
            continue
        # An unknown element stands within its line, as in a browser.
        if tag in BLOCK:
            current = None
        if token["end"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in INLINE:
                continue
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].tag == tag:
                    del stack[at:]
                    while skips and skips[-1].depth > at:
                        skips.pop()
                    break
            continue
        # A start tag within a skipped element closes nothing around it.
        floor = skips[-1].depth if skips else 0
        if tag == "a":
            anchors = 1
            if current is not None:
                current.links += 1
        if tag in INLINE or tag in VOID:
            continue
        if tag in CLOSES:
            _close(stack, *CLOSES[tag], floor)
        if tag in BLOCK:
            anchors = 0
            if len(stack) > floor and stack[-1].tag == "p":
                stack.pop()
        if len(stack) < DEPTH and not token["attrs"].endswith("/"):
            stack.append(_element(tag, token["attrs"]))
    for block in blocks:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in blocks if b.text]
