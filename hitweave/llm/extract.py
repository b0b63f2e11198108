"""Main text of web pages by tag-path ratios.

Every text node belongs to its root-to-leaf path of tags (without those that only
format words).  Over all nodes of a path, the text ratio is the characters per node
and the punctuation ratio the punctuation marks per node; the text of links counts
against a path.  Both are smoothed along the page, each node by those that follow
it: a short heading or lead is lifted by what it leads to, a short closing line
isn't.  They are fused by their product, and a path is content where the mean of its
nodes reaches a share of the page's (weighed by characters).

The content paths fix the region, the smallest element that holds most of their
characters, or the ``article`` or ``main`` around it.  In the region, paths of links
are rejected; so are, where no ``article`` or ``main`` vouches for it, paths of
paragraphs and of text without a container of its own that aren't content.
Headings and paragraphs on content paths outside of the region stay.

What is marked as no part of the main text, by its tag, role, class or id, is left
out first.  But a mark is evidence, not proof: it doesn't stand where the page would
have next to no text without the element.  Tags like ``nav`` and ``footer`` are proof.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import extended, free

#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of the main text.
NEVER = frozenset("nav footer menu script style noscript template button select option input textarea iframe object canvas svg dialog head title datalist".split())
#: Elements that are marked by their tag, strongly and weakly; so is a header outside of an article.
ASIDE, MOSTLY = frozenset(["aside"]), frozenset("form search".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes: elements with optional end tags.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that mark an element as no part of the main text.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side-bar aside footer footnav masthead banner ad ads adv advert adverts advertisement adslot "
    "advertising sponsor sponsored promo promotion comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar "
    "search searchbox widget skip-link contentinfo complementary copyright".split()
)
#: Elements that are parts of a text, so that the region is what holds them.
PARTS = frozenset("p b strong em i span a u font small li ul ol dl dd dt h1 h2 h3 h4 pre blockquote td th tr tbody table".split())
#: Words of class and id that show what holds the text, so that a mark beside them says less.
HOLDERS = frozenset("content article post entry main body story text page layout wrapper container blog hentry".split())
#: Words before a mark that tell of an element what it has, not what it is.
HAVING = frozenset("has have with no non not without show hide is".split())
#: Elements that only format words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Headings, and other elements whose text may be short.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHORT = HEADINGS | frozenset("li dt dd td th tr table tbody caption figcaption blockquote pre address summary".split())
#: Weights of a node and of those after it, and the share of the page's mean at which a path is content.
KERNEL, SHARE = (1.0, 0.6, 0.14), 0.3
#: Links' share of the characters of a path of links.
LINKS = 0.6
#: Elements within one another at most; what is deeper counts to the last.
DEPTH = 512

_EXPRESSIONS: dict = {}


def _expression(name):
    """The compiled patterns, made once in each process."""
    import re

    if not _EXPRESSIONS:
        _EXPRESSIONS["token"] = re.compile(
            r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
            r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)(?:>|\Z)|([^<]+|<)""",
            re.S,
        )
        _EXPRESSIONS["attribute"] = re.compile(r"""(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
        _EXPRESSIONS["part"] = re.compile(r"[-_]+|(?<=\D)\d+")
        _EXPRESSIONS["punctuation"] = re.compile("[.,;:!?。，]")
        for tag in RAW:
            _EXPRESSIONS[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
    return _EXPRESSIONS[name]


#: How an element is marked: not at all, by a part of a name, by a name or its tag, as never to be read.
NONE, WEAK, STRONG, HIDDEN = range(4)


def _mark(attributes):
    """How the attributes mark an element."""
    got, holds = NONE, False
    for name, value in _expression("attribute").findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value in ("", "hidden", "true") or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name in ("hidden", "aria-hidden"):
            continue
        for word in value.split():
            parts = _expression("part").split(word)
            holds = holds or not HOLDERS.isdisjoint(parts)
            if parts[0] in HAVING:
                continue
            if word in MARKS or parts[0] in MARKS:
                got = STRONG
            elif not MARKS.isdisjoint(parts):
                got = max(got, WEAK)
    return min(got, WEAK) if holds else got


class _Page:
    """A page's elements by number, each after its parent, and its text nodes: (element, in a link, text, block)."""

    def __init__(self, html):
        self.parent, self.tag, self.path, self.mark, self.depth = [0], [""], [0], [NONE], [0]
        self.nodes, self.paths = [], {}
        self._open, self._count, self._nested, self._over = [0], {}, {}, {}
        self._link, self._block = 0, 0
        self._read(html)

    def _push(self, tag, mark):
        if len(self._open) >= DEPTH:
            self._over[tag] = self._over.get(tag, 0) + 1
            return
        top = self._open[-1]
        step = (self.path[top], tag)
        self.path.append(self.path[top] if tag in INLINE else self.paths.setdefault(step, len(self.paths) + 1))
        self.parent.append(top)
        self.tag.append(tag)
        self.mark.append(mark)
        self.depth.append(self.depth[top] + 1)
        self._open.append(len(self.tag) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _cut(self, n):
        """Closes the open elements from the n-th on."""
        for e in self._open[n:]:
            self._count[self.tag[e]] -= 1
        del self._open[n:]
        if self._link > n:
            self._link = 0

    def _close(self, tag):
        if self._over.get(tag):
            self._over[tag] -= 1
            return
        if not self._count.get(tag):
            return
        for n in range(len(self._open) - 1, 0, -1):
            here = self.tag[self._open[n]]
            if here == tag:
                return self._cut(n)
            if tag in INLINE and here in BLOCK:
                return  # an inline end tag does not reach beyond its block

    def _close_p(self):
        """A new block closes a p, if no other block stands in between."""
        if self._count.get("p"):
            for n in range(len(self._open) - 1, 0, -1):
                here = self.tag[self._open[n]]
                if here == "p":
                    return self._cut(n)
                if here in BLOCK or here in ("button", "object"):
                    return

    def _implied(self, tag):
        """What an opening tag closes."""
        shut, bounds = CLOSES[tag]
        if not any(self._count.get(t) for t in shut):
            return
        for n in range(len(self._open) - 1, 0, -1):
            here = self.tag[self._open[n]]
            if here in bounds:
                return
            if here in shut:
                self._cut(n)
                return self._implied(tag)

    def _start(self, tag, attributes):
        if tag == "a":
            self._link = len(self._open)
        if tag in BLOCK:
            self._block += 1
            self._close_p()
        if tag in CLOSES:
            self._implied(tag)
        mark = _mark(attributes) if attributes and tag not in ("html", "body", "main", "article") else NONE
        if tag in NEVER:
            mark = HIDDEN
        elif tag in ASIDE or tag == "header" and not (self._count.get("article") or self._count.get("main")):
            mark = max(mark, STRONG)
        elif tag in MOSTLY:
            mark = max(mark, WEAK)
        if tag not in INLINE or mark:
            self._push(tag, mark)
        elif self._count.get(tag):
            self._nested[tag] = self._nested.get(tag, 0) + 1

    def _read(self, html):
        import html as entities

        match, at, size = _expression("token").match, 0, len(html)
        while at < size:
            end, start, attributes, closed, text = (m := match(html, at)).groups()
            at = m.end()
            if text is not None:
                self.nodes.append((self._open[-1], self._link > 0, entities.unescape(text), self._block))
            elif start is not None:
                tag = start.lower()
                if tag == "br":
                    self.nodes.append((self._open[-1], False, "\n", self._block))
                elif tag in RAW:
                    shut = _expression(tag).search(html, at)
                    at = shut.end() if shut else size
                elif tag in VOID:
                    self._block += tag in BLOCK
                elif not closed or tag in BLOCK:
                    self._start(tag, attributes)
            elif end is not None:
                tag = end.lower()
                self._block += tag in BLOCK
                if tag == "a":
                    self._link = 0
                if tag in INLINE and self._nested.get(tag):
                    self._nested[tag] -= 1
                else:
                    self._close(tag)

    def sums(self, values):
        """What the elements hold, of values by element: each adds to its parent."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def below(self, own):
        """For each element whether it or one around it is ``own``."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def left_out(self):
        """For each element whether what it holds is no part of the main text."""
        mark = self.mark
        hidden = self.below([m == HIDDEN for m in mark])
        own = [0] * len(mark)
        for e, _, text, _ in self.nodes:
            own[e] += 0 if hidden[e] else len(text.strip())
        holds = self.sums(own)
        inside = self.below([t in ("article", "main") for t in self.tag])
        while True:
            under = self.below([m > NONE for m in mark])
            clear = sum(own[e] for e in range(len(own)) if not under[e])
            vouched = any(own[e] and inside[e] and not under[e] for e in range(len(own)))
            # marks that don't stand: the weakest of the outermost, and of these the one that holds most, gives way first
            fall = [
                (-mark[e], holds[e], e)
                for e in range(1, len(mark))
                if NONE < mark[e] < HIDDEN and not under[self.parent[e]] and holds[e] and (holds[e] > clear / 2 if mark[e] == WEAK else holds[e] > 9 * clear and not vouched)
            ]
            if not fall:
                return under
            mark[max(fall)[2]] = NONE


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, joined by a newline; empty if there is none."""
    if not html:
        return ""
    page = _Page(html)
    out = page.left_out()
    nodes = [n for n in page.nodes if not out[n[0]]]
    filled = [(e, link, len(text)) for e, link, text in ((e, link, " ".join(t.split())) for e, link, t, _ in nodes) if text]
    if not filled:
        return ""
    # ratios of the paths
    size = len(page.paths) + 1
    number, text, links, marks = ([0] * size for _ in range(4))
    count = _expression("punctuation").findall
    for e, link, t, _ in nodes:
        t, p = " ".join(t.split()), page.path[e]
        number[p] += bool(t)
        if link:
            links[p] += len(t)
        else:
            text[p] += len(t)
            marks[p] += len(count(t))

    def smooth(values):
        got = []
        for i in range(len(values)):
            some = list(zip(KERNEL, values[i : i + len(KERNEL)]))
            got.append(sum(k * v for k, v in some) / sum(k for k, _ in some))
        return got

    paths = [page.path[e] for e, _, _ in filled]
    fused = [a * (1 + b) for a, b in zip(smooth([text[p] / number[p] for p in paths]), smooth([marks[p] / number[p] for p in paths]), strict=True)]
    mean = sum(v * n for v, (_, _, n) in zip(fused, filled, strict=True)) / sum(n for _, _, n in filled)
    value = [0.0] * size
    for p, v in zip(paths, fused, strict=True):
        value[p] += v / number[p]
    content = [number[p] > 0 and value[p] >= SHARE * mean and links[p] <= LINKS * (links[p] + text[p]) for p in range(size)]
    # the smallest element with most of the content's characters
    own = [0] * len(page.tag)
    for (e, _, n), p in zip(filled, paths, strict=True):
        own[e] += n if content[p] or not any(content) else 0
    holds = page.sums(own)
    region = max((page.depth[e], e) for e in range(len(own)) if holds[e] >= 0.9 * holds[0])[1]
    vouching = region
    while vouching and page.tag[vouching] not in ("article", "main"):
        vouching = page.parent[vouching]
    if vouching:
        region = vouching
    while region and page.tag[region] in PARTS:
        region = page.parent[region]
    within = page.below([e == region for e in range(len(own))])

    def stays(e):
        p = page.path[e]
        tag = e
        while page.tag[tag] in INLINE:
            tag = page.parent[tag]
        tag = page.tag[tag]
        if links[p] > LINKS * (links[p] + text[p]) and tag not in HEADINGS:
            return not any(content)
        if not within[e]:
            return content[p] and (tag in HEADINGS or tag == "p")
        return bool(vouching) or content[p] or tag in SHORT or not any(content)

    known: dict[int, bool] = {}
    blocks: dict[int, list[str]] = {}
    for e, _, t, block in nodes:
        if e not in known:
            known[e] = stays(e)
        if known[e]:
            blocks.setdefault(block, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extracted(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*batch.schema.names[1:], "text", "n_chars"],
        )


def extract(pages: DataFrame, html_col: str = "html", carry: Iterable[str] = ("page_id", "url"), suffix: str = "") -> DataFrame:
    """``(*carry, text, n_chars)`` for every row of ``pages``: the main text of the whole html.

    Null and empty html, and pages without text, give the empty string; rows
    repeated in ``pages`` each give a row.  Nothing is shuffled.  ``suffix`` ends
    the names of the two columns, which give way to carried ones of their names
    by underscores.
    """
    carry = list(carry)
    out = pages.select(F.col(html_col).cast("string").alias("_html"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = extended(out, 1, "text string, n_chars long")
    got = out.mapInArrow(_extracted, schema)
    names = free(("text", "n_chars"), carry, suffix)
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("text").alias(names[0]), F.col("n_chars").alias(names[1]))
