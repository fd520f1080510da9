"""Pages as blocks of text in their elements. Plain functions that run inside tasks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import xxhash

# Names of elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title template xmp svg canvas object audio video".split())
RAW_TO_END = frozenset("script style textarea title".split())  # the others need their end, or are read as if they were not there
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul head".split()
)
# an opening element ends these if they are open, up to the nearest of the borders
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "summary", "figcaption"}
SCOPE = frozenset("table td th button article section div body html li blockquote".split())
# elements, roles and words in class or id that mark what is not the article
ASIDE_NAMES = frozenset("head nav aside footer form button select menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended "
    "footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion share sharing social "
    "newsletter subscribe subscription signup login search pagination pager skip paywall".split()
)
# labels with these words do not name the element itself, nor do labels that begin with those
NOT_OWN = frozenset("no has with without".split())
NOT_OWN_FIRST = frozenset("tag category cat type format post page".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
MAIN = frozenset(("article", "main"))
# how an element is set aside: by a word in its class or id, by what it is, or as an article within the former
BY_WORD, BY_KIND, SPARE = 1, 2, 3

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]")


# elements that can hold a whole article
HOLDERS = frozenset("html body main article section div center table tbody tr td blockquote details dl ul ol form fieldset".split())


@dataclass(slots=True)
class Block:
    """Text of one block: where it stands, whether that is set aside, and what part of it is links.

    ``spare`` blocks are set aside too, but are the article of a page without another.
    ``worded`` ones are set aside by a word in a label only.
    """

    path: int
    text: str
    aside: bool
    main: bool
    linked: bool
    spare: bool = False
    worded: bool = False
    links: int = 0  # characters of the text inside links, about


@dataclass(slots=True)
class Tag:
    """An element of a page: its path names it and those around it."""

    path: int
    parent: int
    holder: bool


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _aside(name: str, attributes: dict[str, str], in_main: bool) -> int:
    """How an element is set aside by itself, 0 if it is not."""
    if name in ASIDE_NAMES or name == "header" and not in_main:
        return BY_KIND
    if name in ("html", "body"):
        return 0
    if attributes.get("role", "").lower() in ASIDE_ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes:
        return BY_KIND
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return BY_KIND
    if name == "main" or attributes.get("role") == "main" or name == "header":
        return 0
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(label)]
        if not words or NOT_OWN.intersection(words):
            continue
        if name == "article":
            if words[0] in COMMENT_WORDS:
                return BY_WORD
        elif words[0] in ASIDE_WORDS or words[-1] in ASIDE_WORDS and (words[0] not in NOT_OWN_FIRST or COMMENT_WORDS.intersection(words)):
            return BY_WORD
    return 0


def _inherited(parent: int, own: int, name: str, attributes: dict[str, str], in_main: bool) -> int:
    """How an element is set aside within its parent: one set aside by a word gives way to an article in it."""
    if parent == SPARE:
        return BY_KIND if own else SPARE
    if parent == BY_WORD and not own and not in_main:
        if name == "main" or attributes.get("role") == "main":
            return 0
        if name == "article":
            return SPARE
    return max(parent, own)


def _signature(name: str, attributes: dict[str, str]) -> str:
    return f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}" if attributes else name


def digest(parent: int, what: str) -> int:
    """A signed 64-bit name of something below ``parent``."""
    found = xxhash.xxh64_intdigest(f"{parent}>{what}")
    return found - (1 << 64) if found >> 63 else found


def read(html: str) -> tuple[list[Block], list[Tag]]:
    """The blocks of a page in order, and its opening tags."""
    blocks: list[Block] = []
    tags: list[Tag] = []
    # name, path, set aside, within the main part, within a link
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    buffer: list[str] = []
    plain, links = False, 0  # whether the buffer has text outside links, and characters inside them
    at, end = 0, len(html)
    names: dict[tuple[int, str], int] = {}
    endless: set[str] = set()  # raw elements without an end from here on

    def flush() -> None:
        nonlocal plain, links
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                _, path, aside, main, _ = stack[place()]
                inside = min(links, len(text)) if plain else len(text)
                blocks.append(Block(path, text, aside > 0, main, not plain, aside == SPARE, aside in (BY_WORD, SPARE), inside))
        plain, links = False, 0

    def place() -> int:
        """The innermost open block element."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in BLOCK:
                return i
        return 0

    def write(text: str) -> None:
        nonlocal plain, links
        buffer.append(unescape(text) if "&" in text else text)
        if stack[-1][4]:
            links += len(text)
        else:
            plain = plain or not text.isspace()

    def close(names_: frozenset | set, borders: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names_:
                del stack[i:]
                return
            if stack[i][0] in borders:
                return

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            write(html[at:])
            break
        if m.start() > at:
            write(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/") and name not in endless:
                tail = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                if tail:
                    at = TAG.search(html, tail.start()).end()
                elif name in RAW_TO_END:
                    at = end
                else:
                    endless.add(name)
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                close({"p"}, SCOPE)
        if name in ENDS:
            close(*ENDS[name])
        attributes = _attributes(m[3])
        parent = stack[-1]
        key = (parent[1], _signature(name, attributes))
        path = names.get(key)
        if path is None:
            path = names[key] = digest(*key)
        tags.append(Tag(path, parent[1], name in HOLDERS))
        if name in VOID:
            continue
        aside = _inherited(parent[2], _aside(name, attributes, parent[3]), name, attributes, parent[3])
        stack.append((name, path, aside, parent[3] or name in MAIN or attributes.get("role") == "main", parent[4] or name == "a"))
    flush()
    return blocks, tags
