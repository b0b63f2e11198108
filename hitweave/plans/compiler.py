"""From a query's tree to one lazy DataFrame."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..collection import Collection
from ..functions.values import parse_date
from ..operators import feedback, positional, reducers, scoring, sets, sorting, structural, terms, typed
from ..operators.results import result
from .errors import QueryError
from .rewrite import rewrite
from .syntax import Node, Op, Term, parse, parse_infix, parse_rpn, to_rpn


_BOX = re.compile(r"(?:RECT)?[\[{(]?\s*" + r"\s*,\s*".join([r"(-?[0-9.]+)"] * 4) + r"\s*[\]})]?")


@dataclasses.dataclass
class Engine:
    """Compiles queries over a collection.

    ``model``: the relevance model of the terms with its settings; ``ranker``: none,
    ``e1`` or ``e2`` applied to the whole set; ``types``: the types of fields; ``other``:
    collections by name for JOIN and feedback; ``thesaurus``: narrower words, by which
    terms are expanded; ``before`` and ``after``: hooks that a query and its result
    set go through.
    """

    collection: Collection
    model: str = "l2"
    settings: dict = dataclasses.field(default_factory=dict)
    ranker: str = ""
    types: dict[str, str] = dataclasses.field(default_factory=dict)
    other: dict[str, Engine] = dataclasses.field(default_factory=dict)
    thesaurus: dict[str, list[tuple[str, float]]] = dataclasses.field(default_factory=dict)
    before: list[Callable[[Node], Node]] = dataclasses.field(default_factory=list)
    after: list[Callable[[DataFrame], DataFrame]] = dataclasses.field(default_factory=list)
    warnings: list[str] = dataclasses.field(default_factory=list)
    _leaves: dict[Term, DataFrame] = dataclasses.field(default_factory=dict)

    def compile(self, query: Node | str) -> DataFrame:
        """The result set of a query, as a plan that nothing has run yet (but FOCUS-like relaxations of SearchSmart)."""
        node = parse(query) if isinstance(query, str) else query
        for hook in self.before:
            node = hook(node)
        found = self._node(rewrite(node))
        if self.ranker == "e1":
            found = scoring.euclidean(found)
        elif self.ranker == "e2":
            found = scoring.coverage(found)
        for hook in self.after:
            found = hook(found)
        return found

    def _node(self, node: Node) -> DataFrame:
        return self.leaf(node) if isinstance(node, Term) else self._op(node)

    def _exts(self) -> DataFrame:
        if self.collection.extents is None:
            raise QueryError(114, "the collection has no fields")
        return self.collection.extents

    def leaf(self, t: Term) -> DataFrame:
        """A term's set with its scores; terms that repeat are planned once."""
        if t not in self._leaves:
            self._leaves[t] = self._leaf(t)
        return self._leaves[t]

    def _leaf(self, t: Term) -> DataFrame:
        c = self.collection
        if t.match == "record":
            return self._like(t)
        if t.relation:
            found = self._typed(t)
            if self._box(t) is not None:  # scored by how far the boxes overlap
                return terms.weighted(found, t.weight)
        elif t.match == "word" and t.text.lower() in self.thesaurus:
            found = feedback.expanded(c, t.text, self.thesaurus)
        else:
            found = {
                "word": terms.term, "prefix": terms.prefix, "suffix": terms.suffix, "contains": terms.containing, "glob": terms.glob, "case": terms.case_term,
                "case_prefix": terms.case_prefix, "exact": terms.exact_term, "fuzzy": terms.fuzzy, "sound": terms.sounding, "free": terms.term,
                "phrase": lambda c, text: terms.phrase(c, text.split()),
            }[t.match](c, t.text)
            if t.match == "word" and t.text.lower() in c.stopwords:
                self.warnings.append(f"stopword: {t.text}")
        if t.field and not t.relation:
            found = structural.within(found, self._exts(), t.field)
        found = scoring.score(found, c, self.model, weight=t.weight, **self.settings)
        return terms.free_form(found) if t.match == "free" else found

    def _box(self, t: Term) -> list[float] | None:
        """The sides of a predicate on a box field."""
        m = _BOX.fullmatch(t.text) if t.relation and self.types.get(t.field) in (None, "box", "bounding-box") else None
        return [float(x) for x in m.groups()] if m else None

    def _like(self, t: Term) -> DataFrame:
        """Records like that of a key: the OR of its words, or of those in one of its fields (``key/field``)."""
        source = self.other[t.field].collection if t.field in self.other else self.collection if t.field == self.collection.name else None
        if source is None:
            raise QueryError(114, f"no collection {t.field}")
        key, _, field = t.text.partition("/")
        return feedback.like_key(self.collection, source, key, field or None, t.weight)

    def _typed(self, t: Term) -> DataFrame:
        """A predicate by the field's type; without a declared type, by what the literal looks like."""
        exts, field, how, text = self._exts(), t.field, t.relation, t.text
        kind = self.types.get(field)
        if (box := self._box(t)) is not None:
            return typed.boxed(exts, field, *box)
        if kind is None:
            kind = "date" if text.startswith("#") or re.fullmatch(r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[\[{][0-9]{4}-.*", text) else "number" if re.fullmatch(r"-?[0-9.]+", text) else "range" if re.fullmatch(r"[\[(].*[\])]|.+\.\..+", text) else "currency" if re.match(r"[$£¥€¤]", text) else "text"
        if kind in ("number", "numerical", "num", "computed", "range"):
            m = re.fullmatch(r"[\[({]?\s*(-?[0-9.]+)\s*(?:,|\.\.)\s*(-?[0-9.]+)\s*[\])}]?", text)
            if m:
                return typed.interval(exts, field, float(m[1]), float(m[2]))
            try:
                return typed.numeric(exts, field, how, float(text))
            except ValueError:
                raise QueryError(113, f"{field} is numeric: {text}") from None
        if kind in ("date", "daterange", "date-range", "time"):
            m = re.fullmatch(r"[\[{(]\s*#?([^,]+),\s*#?([^,]+)[\]})]", text)
            if m:
                spans = [parse_date(x) for x in m.groups()]
                if None in spans:
                    raise QueryError(125, text)
                return typed.dated(exts, field, how, str(spans[0].lo), str(spans[1].lo))
            span = parse_date(text.lstrip("#"))
            if span is None:
                raise QueryError(125, text)
            if span.precision in ("year", "month") or (span.precision == "day" and how in ("=", "==")):
                import datetime

                return typed.dated(exts, field, how, str(span.lo), str(span.hi - datetime.timedelta(microseconds=1)))
            return typed.dated(exts, field, how, str(span.lo))
        if kind == "currency":
            return typed.money(exts, field, how, text)
        if kind in ("hash", "casehash", "lexi"):
            return typed.hashed(exts, field, text, kind)
        if kind == "boolean":
            return typed.truth(exts, field, text.lower()[:1] in "1ty")
        if kind in ("phonetic", "phone2", "metaphone", "name"):
            return typed.phonetic(exts, field, text.split(), "metaphone" if kind in ("metaphone", "name") else "soundex")
        if how in ("<>", "!="):
            return structural.not_field(self.collection.described(), structural.within(terms.term(self.collection, text), exts, field), exts, field)
        found = terms.prefix(self.collection, text) if how in (">", ">=") else terms.term(self.collection, text)
        return structural.within(found, exts, field)

    def _op(self, node: Op) -> DataFrame:
        c, name, arg = self.collection, node.name, node.arg
        if name == "EMPTY":
            self.warnings.append("operands cannot be siblings")
            return result(c.described().where("false").select("rec_id"))
        if not node.operands:
            return terms.by_meta(c, "key" if name == "KEY" else "file_name", arg)
        if name in ("JOIN", "JOINL", "JOINR"):
            return self._join(node)
        got = [self._node(x) for x in node.operands]
        if len(got) == 1:
            return self._unary(name, arg, node.relation, got[0])
        a, b = got
        if arg is not None and name in ("AND", "OR", "BEFORE", "AFTER", "PEER") and not re.fullmatch(r"-?[0-9.]+%?", arg):
            exts = self._exts()
            if name == "OR":
                return structural.or_field(a, b, exts, arg)
            return structural.and_field(a, b, exts, arg, {"BEFORE": "before", "AFTER": "after"}.get(name))
        plain = {
            "OR": sets.or_, "AND": sets.and_, "ANDNOT": sets.andnot, "NOTAND": sets.notand, "XOR": sets.xor, "MAYBE": sets.maybe, "PROMOTE": sets.promote,
            "DEMOTE": sets.demote, "ADJ": positional.adj, "FOLLOWS": positional.follows, "PRECEDES": positional.precedes,
        }
        if name in plain:
            return plain[name](a, b)
        if name in ("XNOR", "NOR", "NAND"):
            return {"XNOR": sets.xnor, "NOR": sets.nor, "NAND": sets.nand}[name](c.described(), a, b)
        if name in ("PEER", "PEERB", "PEERA"):
            return structural.peer(a, b, self._exts(), {"PEERB": "before", "PEERA": "after"}.get(name))
        if name == "XPEER":
            return structural.xpeer(a, b, self._exts())
        if name == "ANCESTOR":
            return structural.ancestor(a, b, self._exts())
        if name == "NEIGHBOR":
            return positional.neighbor(a, b, c.described())
        if name == "FAR":
            return structural.xpeer(a, b, c.extents) if c.extents is not None and arg is None else positional.far(a, b, int(arg or positional.NEAR))
        return self._near(name, arg, node.relation, a, b)

    def _near(self, name: str, arg: str | None, relation: str | None, a: DataFrame, b: DataFrame) -> DataFrame:
        order = {"BEFORE": "before", "AFTER": "after"}.get(name)
        if arg is None or (name == "PROX" and float(arg.rstrip("%")) == 0):
            if self.collection.extents is not None:
                return structural.peer(a, b, self.collection.extents, order)
            return positional.near(a, b, positional.NEAR, order)
        if arg.endswith("%") or (0 < float(arg) < 1):
            share = float(arg.rstrip("%")) / (100 if arg.endswith("%") else 1)
            return positional.near(a, b, positional.share_of_length(share), order, lengths=self.collection.described())
        n = int(float(arg))
        if relation in (">", ">="):
            return positional.near(a, b, n + (relation == ">"), order, far=True)
        if relation == "<":
            n -= 1
        return positional.near(a, b, abs(n), order, far=n < 0 and relation is None)

    def _unary(self, name: str, arg: str | None, relation: str | None, a: DataFrame) -> DataFrame:
        c = self.collection
        if name == "NOT":
            return sets.not_(c.described(), a) if arg is None else structural.not_field(c.described(), a, self._exts(), arg)
        if name in ("WITHIN", "INSIDE"):
            if arg[0].isdigit():
                low, _, high = arg.partition("..") if ".." in arg else arg.partition(",")
                first, last = parse_date(low), parse_date(high or low)
                if first is None or last is None:
                    raise QueryError(125, arg)
                return reducers.in_dates(a, c, str(first.lo), str(last.hi))
            return structural.within(a, self._exts(), arg)
        if name == "XWITHIN":
            return structural.xwithin(a, self._exts(), arg)
        if name == "INCLUSIVE":
            return structural.inclusive(a, self._exts(), arg)
        if name in ("WITHKEY", "KEY"):
            return reducers.with_meta(a, c, "key", arg)
        if name == "FILE":
            return reducers.with_meta(a, c, "file_name", arg)
        if name == "EXTENSION":
            return reducers.with_meta(a, c, "file_name", f"*.{arg.lstrip('.')}")
        if name == "DOCTYPE":
            return reducers.with_meta(a, c, "doctype", arg)
        if name == "REDUCE":
            return reducers.reduce(a, int(arg or 0))
        if name == "FOCUS":
            return reducers.focus(a, int(arg or 0))
        if name == "HITCOUNT":
            return reducers.hit_count(a, int(arg or 1), relation)
        if name == "TRIM":
            return reducers.trim(a, int(arg))
        if name == "BOOST":
            return reducers.boost(a, float(arg))
        if name == "SORTBY":
            return sorting.sort(a, c, {"byscore": "score", "byhits": "hits", "bydate": "date", "bykey": "key", "byindex": "index", "byauxcount": "auxcount", "bynewsrank": "newsrank"}.get(arg.lower(), arg))
        raise QueryError(110, name)

    def _join(self, node: Op) -> DataFrame:
        """JOIN: the right operand over another collection (``JOIN:name``); without one, AND."""
        left, right = node.operands
        if node.arg is None:
            return sets.and_(self._node(left), self._node(right))
        if node.arg not in self.other:
            raise QueryError(114, f"no collection {node.arg}")
        far = self.other[node.arg]
        a, b = self._node(left), far._node(right)
        if node.name == "JOINR":
            return sets.join_key(b, far.collection.described(), a, self.collection.described())
        return sets.join_key(a, self.collection.described(), b, far.collection.described())


def search(c: Collection, query: Node | str, notation: str = "", sort: str = "score", top: int | None = None, start: int = 0, **options) -> DataFrame:
    """``query`` over ``c`` in an order, from place ``start`` on ``top`` records; deleted records are left out last.

    ``notation``: rpn, infix, or what fits.
    """
    node = {"rpn": parse_rpn, "infix": parse_infix}.get(notation, parse)(query) if isinstance(query, str) else query
    found = Engine(c, **options).compile(node)
    kept = found.join(c.described().where("not deleted").select("rec_id"), "rec_id", "left_semi")
    out = sorting.sort(kept, c, sort)
    out = out.offset(start) if start else out
    return out.limit(top) if top else out


def search_smart(engine: Engine, text: str, field: str | None = None) -> tuple[DataFrame, str]:
    """Plain words by ever looser readings until there is a result: as a phrase, as peers (or in one field), then those of the OR with all words.

    Returns the set and the query that gave it.
    """
    words = re.findall(r"[a-z0-9]+", text.lower())
    if len(words) < 2 or len(words) != len(text.split()):
        node = parse(text)
        return engine.compile(node), to_rpn(node)
    chain: Node = Term(words[0])
    readings: list[Node] = [Term(" ".join(words), "phrase")]
    if engine.collection.extents is not None:
        for w in words[1:]:
            chain = Op("AND", (chain, Term(w)), field) if field else Op("PEER", (chain, Term(w)))
        readings.append(chain)
    loose: Node = Term(words[0])
    for w in words[1:]:
        loose = Op("OR", (loose, Term(w)))
    readings.append(Op("REDUCE", (loose,), str(len(words))))
    for node in readings:
        found = engine.compile(node)
        if not found.isEmpty():
            break
    return found, to_rpn(node)
