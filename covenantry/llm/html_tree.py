"""Pages as trees: elements and, as leaves, runs of text that no block boundary interrupts.

Time is in proportion to a page's length whatever its markup: a scan goes forward only, what does not
come again is remembered, and the places of open elements are kept by tag."""

from __future__ import annotations

import html
import re

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_AS_IT_STANDS = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_HINTS = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'\bdata-content="([01])"')
_WHITE = re.compile(r"\s+")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # what they hold is no markup and no text of the page
ENCLOSING = frozenset("audio canvas noscript object select svg template video".split())  # one that is never ended has nothing in it
INLINE = frozenset(
    "a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtext munder nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_ENDS = {x: re.compile(rf"</{x}(?![a-z0-9])", re.I) for x in (*RAW, *ENCLOSING)}
MAX_DEPTH = 512  # as in browsers: what is nested deeper hangs on the element at that depth


class Tree:
    """Parallel lists over nodes; node 0 is the page, and a parent comes before its children."""

    __slots__ = ("parent", "tag", "hint", "label", "text", "links")

    def __init__(self):
        self.parent, self.tag, self.hint, self.label, self.text, self.links = [-1], ["#page"], [""], [None], [None], [0]

    def add(self, parent: int, tag: str, hint: str = "", label: int | None = None, text: str | None = None, links: int = 0) -> int:
        for values, x in zip((self.parent, self.tag, self.hint, self.label, self.text, self.links), (parent, tag, hint, label, text, links), strict=True):
            values.append(x)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page. Unknown or unclosed markup never fails; what is left open ends with the page.

    Once a tag's quote is never closed, quotes of later tags are not looked at."""
    tree = Tree()
    stack: list[tuple[str, int, int]] = [("#page", 0, 0)]  # tag, node and depth of open elements; inline ones have those of their block
    places: dict[str, list[int]] = {"#page": [0]}  # of open elements in the stack
    run, linked = [], 0

    def end_run() -> None:
        nonlocal run, linked
        if run:
            text = _WHITE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                tree.add(stack[-1][1], "#text", text=text, links=linked)
        run, linked = [], 0

    def text(value: str) -> None:
        nonlocal linked
        run.append(value)
        if places.get("a"):
            linked += len(value.strip())

    def close(k: int) -> None:
        """End the element at ``stack[k]`` and all within."""
        if len(stack) == k + 1:  # the innermost
            tag = stack[k][0]
            if tag not in INLINE:
                end_run()
            places[tag].pop()
            stack.pop()
            return
        gone = [tag for tag, _, _ in stack[k:]]
        if not INLINE.issuperset(gone):
            end_run()
        for tag in gone:
            places[tag].pop()
        del stack[k:]

    def find(tags, stop) -> int:
        """The innermost open element with one of the tags, if none of ``stop`` is within it; else 0."""
        k = 0
        for x in tags:
            if (at := places.get(x)) and at[-1] > k:
                k = at[-1]
        if k:
            for x in stop:
                if (at := places.get(x)) and at[-1] > k:
                    return 0
        return k

    def next_end(tag: str, at: int) -> int:
        if ends.get(tag, -1) < at:
            found = _ENDS[tag].search(page, at)
            ends[tag] = found.start() if found else len(page)
        return ends[tag]

    def push(tag: str, node: int, depth: int) -> None:
        if tag in places:
            places[tag].append(len(stack))
        else:
            places[tag] = [len(stack)]
        stack.append((tag, node, depth))

    last_end, closed = page.rfind(">"), True  # no tag ends after it; whether all quotes so far were closed
    ends: dict[str, int] = {}  # where an element's next end tag is, for those that were sought
    at = 0
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end:
            text(page[at:])
            break
        if page[begin + 1 : begin + 2] in ("!", "?"):
            text(page[at:begin])
            if page.startswith("<!--", begin):
                over = _COMMENT_END.search(page, begin + 4)
                at = over.end() if over else len(page)
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                text(html.escape(page[begin + 9 : end if end >= 0 else len(page)]))
                at = end + 3 if end >= 0 else len(page)
            else:
                at = page.find(">", begin) + 1
            continue
        token = _TAG.match(page, begin + 1) if closed else None
        if token is None:
            token = _TAG_AS_IT_STANDS.match(page, begin + 1)
            if token is not None:
                closed = False
        if token is None:  # no tag at all
            text(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            text(page[at:begin])
        at = token.end()
        tag = token[2].lower()
        if token[1]:
            if tag == "br":
                text(" ")
            elif stack[-1][0] == tag:
                close(len(stack) - 1)
            elif places.get(tag) and (k := find((tag,), () if tag not in INLINE else ("table", "td"))):
                close(k)
            continue
        if tag in RAW:
            end = next_end(tag, at)
            over = page.find(">", end) if end < len(page) else -1
            at = over + 1 if over >= 0 else at if token[3].rstrip().endswith("/") else len(page)
            continue
        if tag == "br" or tag == "img":
            text(" ")
            continue
        if places.get("p") and tag in CLOSES_P and (k := find(("p",), ("button", "table", "td"))):
            close(k)
        if tag in _CLOSES and (k := find(*_CLOSES[tag])):
            close(k)
        if tag == "a" and places.get("a") and (k := find(("a",), ("table", "td"))):
            close(k)
        if tag in INLINE:
            push(tag, *stack[-1][1:])
            continue
        end_run()
        if tag in VOID:
            continue
        if tag in ENCLOSING:
            if next_end(tag, at) == len(page) or token[3].rstrip().endswith("/"):
                continue
        attributes = token[3]
        hint = " ".join("".join(x) for x in _HINTS.findall(attributes)).lower() if attributes else ""
        marked = _LABEL.search(attributes) if attributes else None
        _, above, depth = stack[-1]
        if depth < MAX_DEPTH:
            above, depth = tree.add(above, tag, hint, int(marked[1]) if marked else None), depth + 1
        push(tag, above, depth)
    end_run()
    return tree
