"""HTML, XML and SGML as reading text with nested extents.

The text is what is read: tags are gone, character references are decoded, and
blocks stand on lines of their own.  An element is an extent of that text, named by
the path of its tags; an attribute is an extent without a place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[A-Za-z_][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<start>[A-Za-z_][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*?)(?P<shut>/?)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNREAD = frozenset("script style template noscript".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A tag that opens closes those open, as far as the innermost of its bounds.
_IMPLIED = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",), "body": ("head",),
}
_BOUNDS = frozenset("ul ol dl table select body html div section article blockquote".split())


#: What ``references`` of ``parse`` names: all that HTML knows, as browsers read them, or those alone that markup itself needs, closed by a semicolon.
_MARKUP = {"&lt;": "<", "&gt;": ">", "&amp;": "&"}
REFERENCES = {"all": html.unescape, "markup": lambda text: re.sub("&(?:lt|gt|amp);", lambda m: _MARKUP[m[0]], text)}


def parse(source: str, is_html: bool = True, references: str = "all") -> tuple[str, list[tuple[str, int | None, int | None, int, str | None]]]:
    """The reading text, and ``(path, start, end, depth, value)`` of its elements and attributes; an element's value is its text."""
    decoded = REFERENCES[references]
    out: list[str] = []
    size = 0
    fields: list[tuple[str, int | None, int | None, int, str | None]] = []
    open_: list[tuple[str, int]] = []  # tag, where its text begins
    unread = 0

    def add(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            add("\n")

    def path() -> str:
        return "/".join(t for t, _ in open_)

    def close(n: int) -> None:
        nonlocal unread
        while len(open_) > n:
            tag, begin = open_[-1]
            if not unread:
                fields.append((path(), begin, size - 1, len(open_) - 1, None))
            open_.pop()
            if is_html and tag in _UNREAD:
                unread -= 1
            elif not (is_html and tag in _INLINE):
                line()

    for m in _TOKEN.finditer(source):
        if m["text"] is not None or m["cdata"] is not None:
            if not unread:
                text = m["cdata"] if m["cdata"] is not None else decoded(m["text"])
                text = re.sub(r"\s+", " ", text)
                if out and out[-1].endswith((" ", "\n")) or not out:
                    text = text.lstrip(" ")
                if text:
                    add(text)
        elif m["start"]:
            tag = m["start"].lower() if is_html else m["start"]
            if unread:
                continue
            if is_html:
                for n in range(len(open_) - 1, -1, -1):
                    if open_[n][0] in _IMPLIED.get(tag, ()):
                        close(n)
                        break
                    if open_[n][0] in _BOUNDS:
                        break
            if not (is_html and tag in _INLINE):
                line()
            open_.append((tag, size))
            for name, value in _ATTRIBUTE.findall(m["attrs"] or ""):
                fields.append((f"{path()}@{name.lower() if is_html else name}", None, None, len(open_), decoded(value.strip("\"'"))))
            if is_html and tag in _UNREAD and not m["shut"]:
                unread += 1
            elif m["shut"] or (is_html and tag in _VOID):
                close(len(open_) - 1)
        elif m["end"]:
            tag = m["end"].lower() if is_html else m["end"]
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][0] == tag:
                    close(n)
                    break
    close(0)
    text = "".join(out)
    # white space at an element's ends is no part of it
    placed = []
    for where, start, end, depth, value in fields:
        if start is not None and value is None:
            body = text[start : end + 1]
            start, value = start + len(body) - len(body.lstrip()), body.strip()
            end = start + len(value) - 1
        placed.append((where, start, end, depth, value))
    placed.sort(key=lambda f: (f[1] if f[1] is not None else -1, f[3]))
    return text, placed


def elements(source: str, tag: str) -> Iterator[tuple[int, int]]:
    """Places of the outermost elements of a tag in the source: the records of a feed."""
    depth = begin = 0
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*?(/?)>", source):
        if not m[1] and not m[2]:
            begin = m.start() if not depth else begin
            depth += 1
        elif m[2] and not depth:
            yield m.start(), m.end()
        elif m[1] and depth:
            depth -= 1
            if not depth:
                yield begin, m.end()
