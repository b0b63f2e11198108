"""Rewriting of queries before they are compiled: what Catalyst can't know about result sets."""

from __future__ import annotations

import dataclasses

from .errors import QueryError
from .syntax import Node, Op, Term


def rewrite(node: Node) -> Node:
    """Bottom-up: double NOT, NOT below AND and OR, folded BOOSTs, WITHIN pushed to terms, SIBLING resolved."""
    if isinstance(node, Term):
        return node
    operands = tuple(rewrite(x) for x in node.operands)
    node = dataclasses.replace(node, operands=operands)
    first = operands[0] if operands else None
    if node.name == "NOT" and node.arg is None and isinstance(first, Op):
        if first.name == "AND" and first.arg is None:
            return Op("NAND", first.operands)
        if first.name == "OR" and first.arg is None:
            return Op("NOR", first.operands)
        if first.name == "XOR":
            return Op("XNOR", first.operands)
    if node.name == "AND" and node.arg is None:
        left, right = operands
        if _is_not(right) and not _is_not(left):
            return Op("ANDNOT", (left, right.operands[0]))
        if _is_not(left) and not _is_not(right):
            return Op("ANDNOT", (right, left.operands[0]))
    if node.name == "BOOST" and isinstance(first, Op) and first.name == "BOOST":
        return Op("BOOST", first.operands, repr(float(node.arg) * float(first.arg)))
    if node.name in ("WITHIN", "INSIDE") and node.arg and not _is_range(node.arg):
        return _pushed(Op("WITHIN", operands, node.arg))
    if node.name == "SIBLING":
        return sibling(first)
    return node


def _is_not(node: Node) -> bool:
    return isinstance(node, Op) and node.name == "NOT" and node.arg is None


def _is_range(arg: str) -> bool:
    """Whether WITHIN's argument is a range of dates and not a field."""
    return bool(arg) and arg[0].isdigit()


def _pushed(node: Op) -> Node:
    """WITHIN of a term is a fielded term; of AND and OR of terms, that of each."""
    inner = node.operands[0]
    if isinstance(inner, Term) and inner.field is None and inner.relation is None and inner.match not in ("free", "record"):
        return dataclasses.replace(inner, field=node.arg)
    if isinstance(inner, Op) and inner.name == "OR" and inner.arg is None:
        return dataclasses.replace(inner, operands=tuple(_pushed(Op("WITHIN", (x,), node.arg)) for x in inner.operands))
    return node


def sibling(node: Node) -> Node:
    """SIBLING: AND, OR and PEER become a chain of PEERs, a term stays; what can't share a container is refused."""
    if isinstance(node, Term):
        return node
    if node.name in ("AND", "OR", "PEER") and node.arg is None:
        return Op("PEER", tuple(map(sibling, node.operands)))
    if node.name in ("XOR", "ANDNOT", "NOTAND", "XPEER"):
        return Op("EMPTY", (), "135")
    raise QueryError(110, f"SIBLING of {node.name}")


def leaves(node: Node) -> list[Term]:
    return [node] if isinstance(node, Term) else [t for x in node.operands for t in leaves(x)]


def needs_hits(node: Node) -> bool:
    """Whether places of hits are used: if not, they are pruned from the plan."""
    if isinstance(node, Term):
        return node.field is not None and node.relation is None and node.match != "record"
    positional = {"PEER", "PEERB", "PEERA", "XPEER", "ANCESTOR", "NEAR", "PROX", "DIST", "BEFORE", "AFTER", "ADJ", "FOLLOWS", "PRECEDES", "NEIGHBOR", "FAR"}
    structural = {"XWITHIN", "INCLUSIVE", "WITHIN", "INSIDE"}
    if node.name in positional | structural or (node.name in ("AND", "OR") and node.arg):
        return True
    return any(map(needs_hits, node.operands))
