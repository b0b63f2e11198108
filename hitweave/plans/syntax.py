"""Queries as trees, and the two notations: reverse-Polish and infix."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterator

from .errors import QueryError


class _Built:
    """Queries from Python: ``word("a") & word("b").within("title") | ~word("c")``."""

    def __and__(self, other: Node) -> Op:
        return Op("AND", (self, other))

    def __or__(self, other: Node) -> Op:
        return Op("OR", (self, other))

    def __xor__(self, other: Node) -> Op:
        return Op("XOR", (self, other))

    def __sub__(self, other: Node) -> Op:
        return Op("ANDNOT", (self, other))

    def __invert__(self) -> Op:
        return Op("NOT", (self,))

    def op(self, name: str, other: Node | None = None, arg: object = None, relation: str | None = None) -> Op:
        """Any operator by its name, over this query and perhaps another."""
        name = name.upper()
        if name not in BINARY and name not in UNARY:
            raise QueryError(110, name)
        if (other is None) != (name in UNARY):
            raise QueryError(108, f"{name} takes {1 + (name in BINARY)}")
        return Op(name, (self,) if other is None else (self, other), None if arg is None else str(arg), relation)

    def near(self, other: Node, distance: int | None = None) -> Op:
        return self.op("NEAR", other, distance)

    def before(self, other: Node, distance: int | None = None) -> Op:
        return self.op("BEFORE", other, distance)

    def peer(self, other: Node) -> Op:
        return self.op("PEER", other)

    def within(self, field: str) -> Op:
        return self.op("WITHIN", arg=field)

    def boost(self, weight: float) -> Op:
        return self.op("BOOST", arg=weight)


@dataclasses.dataclass(frozen=True)
class Term(_Built):
    """A leaf.

    ``match``: word, prefix, suffix, contains, glob, case, case_prefix, exact,
    fuzzy, sound, free, phrase or record (a record's key, whose words are sought;
    the field then names its collection).  With a ``relation`` it is a predicate on a typed
    field.  ``weight`` multiplies the score.
    """

    text: str
    match: str = "word"
    field: str | None = None
    relation: str | None = None
    weight: float = 1.0

    def to_dict(self) -> dict:
        return {"term": dataclasses.asdict(self)}


@dataclasses.dataclass(frozen=True)
class Op(_Built):
    """An operator over its operands; ``arg``: what follows the colon; ``relation``: of DIST and HITCOUNT."""

    name: str
    operands: tuple[Term | Op, ...] = ()
    arg: str | None = None
    relation: str | None = None

    def to_dict(self) -> dict:
        return {"op": self.name, "arg": self.arg, "relation": self.relation, "operands": [x.to_dict() for x in self.operands]}


Node = Term | Op


def word(text: str) -> Term:
    """A leaf in the syntax of terms."""
    return parse_term(text)


def from_dict(d: dict) -> Node:
    if "term" in d:
        return Term(**d["term"])
    return Op(d["op"], tuple(map(from_dict, d["operands"])), d["arg"], d["relation"])


def to_json(node: Node) -> str:
    return json.dumps(node.to_dict())


def from_json(text: str) -> Node:
    return from_dict(json.loads(text))


BINARY = frozenset(
    "OR AND ANDNOT NOTAND XOR XNOR NOR NAND MAYBE PROMOTE DEMOTE JOIN JOINL JOINR PEER PEERB PEERA XPEER ANCESTOR NEAR PROX DIST BEFORE AFTER ADJ FOLLOWS PRECEDES NEIGHBOR FAR".split()
)
UNARY = frozenset("NOT SIBLING WITHIN INSIDE XWITHIN INCLUSIVE WITHKEY KEY FILE EXTENSION DOCTYPE REDUCE FOCUS HITCOUNT TRIM BOOST SORTBY".split())
SYMBOLS = {
    "||": "OR", "|": "OR", "&&": "AND", "&": "AND", "!!": "ANDNOT", "!&": "NOTAND", "&!": "NAND", "^^": "XOR", "^": "XOR", "^!": "XNOR", "|!": "NOR", "!": "NOT",
    ".=.": "PEER", ".<.": "NEAR", ".>.": "FAR", ".#": "BEFORE", "#.": "AFTER", "##": "ADJ", "#>": "FOLLOWS", "#<": "PRECEDES", ".~.": "NEIGHBOR", "><": "NOOP",
}
_ALIASES = {"PROXIMITY": "PROX", "ONEAR": "BEFORE", "WITH": "AND", "BUTNOT": "ANDNOT"}
#: Operators that need what follows the colon.
_ARGUED = frozenset("WITHIN INSIDE XWITHIN INCLUSIVE WITHKEY KEY FILE EXTENSION DOCTYPE BOOST SORTBY TRIM HITCOUNT".split())


def tokens(text: str) -> Iterator[str]:
    """Words, quoted phrases with what is attached to them, and brackets."""
    for m in re.finditer(r"""[()](?::-?[0-9.]+)?|(?:[^\s()"]*(?:"[^"]*"|\[[^\]]*\]|\{[^}]*\}|RECT\{[^}]*\}))[^\s()"]*|[^\s()"]+|"[^"]*$""", text):
        yield m.group()


def operator(token: str, fold: bool = False) -> tuple[str, str | None, str | None] | None:
    """(name, argument, relation) of an operator's token, or None; names in lower case count only where ``fold``."""
    if token in SYMBOLS:
        return SYMBOLS[token], None, None
    m = re.fullmatch(r"([A-Za-z]+)(?:(<=|>=|<|>|=|<>|!=)([0-9.]+%?)|:(.*))?", token)
    if not m:
        return None
    name = m[1].upper()
    if not fold and m[1] != name and m[1] not in ("PEERb", "PEERa", "JOINl", "JOINr"):
        return None
    name = _ALIASES.get(name, name)
    if name == "NOOP":
        return "NOOP", None, None
    if name not in BINARY and name not in UNARY:
        return None
    relation, arg = m[2], m[3] if m[2] else m[4]
    if relation and name not in ("DIST", "HITCOUNT", "NEAR", "PROX", "BEFORE", "AFTER"):
        return None
    if name in ("NEAR", "PROX") and relation in ("<", ">"):  # an order, not a distance
        name, relation = ("AFTER" if relation == ">" else "BEFORE"), None
    if name in _ARGUED and not arg and name not in ("HITCOUNT",):
        raise QueryError(108, f"{token} wants an argument")
    return name, arg or None, relation


def parse_term(token: str) -> Term:
    """A leaf by its syntax: quotes, ``field/``, relations, truncation and the marks at the end."""
    field, relation, weight = None, None, 1.0
    m = re.fullmatch(r'((?:[^\s"/<>=!]+/)*)"([^"]*)"?(\*|=|:-?[0-9.]+)?', token)
    if m:
        field = m[1].rstrip("/") or None
        if m[3] and m[3][0] == ":":
            weight = float(m[3][1:])
        words = re.findall(r"[a-z0-9]+", m[2].lower())
        if not words:
            raise QueryError(125, token)
        return Term(" ".join(words), "phrase" if len(words) > 1 else "case" if m[3] == "=" else "word", field, None, weight)
    m = re.fullmatch(r"([A-Za-z0-9_|\\./-]{2,}?)(<>|!=|<=|>=|=|<|>)(.+)", token)
    if m and not (m[2] == "=" and m[3] == "*"):
        return Term(m[3].strip('"'), "value", m[1].replace("\\", "/").replace("|", "/"), m[2])
    m = re.fullmatch(r"(.*[^:]):(-?[0-9]+(?:\.[0-9]+)?)", token)
    if m:
        token, weight = m[1], float(m[2])
    token = token.replace("\\", "/")
    m = re.fullmatch(r"([\w.-]+)//([^/]+)(/.+)?", token)
    if m:
        return Term(m[2] + (m[3] or ""), "record", m[1], None, weight)
    if "/" in token.strip("/"):
        field, token = token.rsplit("/", 1)
    if not token:
        raise QueryError(125, "an empty term")
    inner, match = token, "word"
    if re.search(r"[?\[{]", token) or "*" in token.strip("*"):
        match = "glob"
    elif token.endswith("=*") or (token.endswith(">") and len(token) > 1):
        inner, match = token.rstrip("=*>"), "case_prefix"
    elif token.startswith("*") and token.endswith("*") and len(token) > 2:
        inner, match = token.strip("*"), "contains"
    elif token.endswith("*"):
        inner, match = token[:-1], "prefix"
    elif token.startswith("*"):
        inner, match = token[1:], "suffix"
    elif len(token) > 1 and token[-1] in "=.~#$":
        inner, match = token[:-1], {"=": "case", ".": "exact", "~": "fuzzy", "#": "sound", "$": "free"}[token[-1]]
    elif token.endswith("@"):
        raise QueryError(110, "dense feedback")
    words = re.findall(r"[a-z0-9]+", inner.lower())
    if match == "word" and len(words) > 1:
        return Term(" ".join(words), "phrase", field, None, weight)
    return Term(inner, match, field, relation, weight)


def parse_rpn(text: str) -> Node:
    """Reverse-Polish: operands before their operator.  Terms that are left over are joined by OR."""
    stack: list[Node] = []
    for token in tokens(text):
        op = operator(token)
        if op is None:
            stack.append(parse_term(token))
            continue
        name, arg, relation = op
        if name == "NOOP":
            continue
        if name in ("KEY", "FILE") and not stack:
            stack.append(Op(name, (), arg))
            continue
        n = 2 if name in BINARY else 1
        if len(stack) < n:
            raise QueryError(108, f"{token} lacks operands")
        operands = tuple(stack[-n:])
        del stack[-n:]
        stack.append(Op(name, operands, arg, relation))
    if not stack:
        raise QueryError(108, "an empty query")
    node = stack[0]
    for other in stack[1:]:
        node = Op("OR", (node, other))
    return node


def parse_infix(text: str) -> Node:
    """Infix: operators stand between operands and bind from left to right, without precedence.

    ``NOT``, ``field/( .. )`` and a boost after a bracket, ``( .. ):2``, bind to the
    bracket or term that they stand at; unary filters with an argument may stand
    before a bracket or after an operand.
    """
    parts, at = list(tokens(text)), 0

    def operand() -> Node:
        nonlocal at
        if at >= len(parts):
            raise QueryError(108, "an operand is missing")
        token = parts[at]
        at += 1
        if token == "(":
            node = expression()
            if at >= len(parts) or not parts[at].startswith(")"):
                raise QueryError(108, "a bracket isn't closed")
            close = parts[at]
            at += 1
            return Op("BOOST", (node,), close[2:]) if len(close) > 1 else node
        m = re.fullmatch(r"(.+?)(//|!/|/)", token)
        if m and at < len(parts) and parts[at] == "(":
            return Op({"/": "WITHIN", "//": "INSIDE", "!/": "XWITHIN"}[m[2]], (operand(),), m[1])
        op = operator(token, fold=True)
        if op is None:
            return parse_term(token)
        name, arg, relation = op
        if name == "NOT" and arg is None:
            return Op("NOT", (operand(),))
        if name in UNARY:
            if name in ("KEY", "FILE") and (at >= len(parts) or parts[at] != "("):
                return Op(name, (), arg)
            return Op(name, (operand(),), arg, relation)
        raise QueryError(108, f"{token} lacks its left operand")

    def expression() -> Node:
        nonlocal at
        node = operand()
        while at < len(parts) and not parts[at].startswith(")"):
            op = operator(parts[at], fold=True)
            if op is None:
                raise QueryError(108, f"no operator before {parts[at]}")
            name, arg, relation = op
            at += 1
            if name == "NOOP":
                continue
            if name == "NOT" and arg is None:
                node = Op("ANDNOT", (node, operand()))
            elif name in UNARY:
                node = Op(name, (node,), arg, relation)
            else:
                node = Op(name, (node, operand()), arg, relation)
        return node

    node = expression()
    if at < len(parts):
        raise QueryError(108, f"unexpected {parts[at]}")
    return node


def parse(text: str) -> Node:
    """Infix if it parses, else reverse-Polish if that uses its operators up, else the OR of the words."""
    parts = list(tokens(text))
    found = [operator(p, fold=True) for p in parts]
    if any(found) or "(" in parts:
        try:
            return parse_infix(text)
        except QueryError:
            return parse_rpn(text)
    node: Node | None = None
    for p in parts:
        node = parse_term(p) if node is None else Op("OR", (node, parse_term(p)))
    if node is None:
        raise QueryError(108, "an empty query")
    return node


def _term_text(t: Term) -> str:
    if t.relation:
        return f"{t.field}{t.relation}{t.text}"
    mark = {"case": "=", "case_prefix": "=*", "exact": ".", "fuzzy": "~", "sound": "#", "free": "$", "prefix": "*"}.get(t.match, "")
    if t.match == "record":
        return f"{t.field}//{t.text}" + (f":{t.weight:g}" if t.weight != 1 else "")
    body = f'"{t.text}"' if t.match == "phrase" else f"*{t.text}*" if t.match == "contains" else f"*{t.text}" if t.match == "suffix" else t.text + mark
    return (f"{t.field}/" if t.field else "") + body + (f":{t.weight:g}" if t.weight != 1 else "")


def to_rpn(node: Node) -> str:
    """The query in reverse-Polish notation."""
    if isinstance(node, Term):
        return _term_text(node)
    own = node.name + (f"{node.relation}{node.arg}" if node.relation else f":{node.arg}" if node.arg is not None else "")
    return " ".join([*map(to_rpn, node.operands), own])
