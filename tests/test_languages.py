"""The two notations, rewriting and diagnostics."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitweave.plans import Op, QueryError, Term, parse, parse_infix, parse_rpn, to_rpn
from hitweave.plans.rewrite import leaves, needs_hits, rewrite
from hitweave.plans.syntax import from_json, operator, parse_term, to_json

A, B, C = Term("a1"), Term("b1"), Term("c1")


def test_rpn():
    assert parse_rpn("a1 b1 AND") == Op("AND", (A, B)) and parse_rpn("a1 b1 && c1 ||") == Op("OR", (Op("AND", (A, B)), C))
    assert parse_rpn("a1 b1 c1 OR AND") == Op("AND", (A, Op("OR", (B, C)))) and parse_rpn("a1 b1") == Op("OR", (A, B))
    assert parse_rpn("a1 b1 NEAR:5") == Op("NEAR", (A, B), "5") and parse_rpn("a1 b1 DIST<=7") == Op("DIST", (A, B), "7", "<=")
    assert parse_rpn("a1 NOT") == Op("NOT", (A,)) and parse_rpn("a1 WITHIN:title") == Op("WITHIN", (A,), "title") and parse_rpn("a1 >< b1 AND") == Op("AND", (A, B))
    assert parse_rpn("a1 b1 and") == Op("OR", (Op("OR", (A, B)), Term("and")))


def test_infix_binds_from_left_to_right():
    assert parse_infix("a1 or b1 and c1") == Op("AND", (Op("OR", (A, B)), C)) and parse_infix("a1 or (b1 and c1)") == Op("OR", (A, Op("AND", (B, C))))
    assert parse_infix("a1 not b1") == Op("ANDNOT", (A, B)) and parse_infix("not a1") == Op("NOT", (A,))
    assert parse_infix("title/(a1 or b1)") == Op("WITHIN", (Op("OR", (A, B)),), "title") and parse_infix("title!/(a1)") == Op("XWITHIN", (A,), "title")
    assert parse_infix("(a1):2.5") == Op("BOOST", (A,), "2.5") and parse_infix("a1 near:5 b1") == Op("NEAR", (A, B), "5")
    assert parse_infix("a1 with:title b1") == Op("AND", (A, B), "title")


@pytest.mark.parametrize("token,want", [
    ("word", Term("word")), ("wor*", Term("wor", "prefix")), ("*ord", Term("ord", "suffix")), ("*or*", Term("or", "contains")), ("w?rd", Term("w?rd", "glob")), ("Word=", Term("Word", "case")),
    ("Wo=*", Term("Wo", "case_prefix")), ("word.", Term("word", "exact")), ("word~", Term("word", "fuzzy")), ("word#", Term("word", "sound")), ("word$", Term("word", "free")),
    ("word:2", Term("word", weight=2.0)), ("word:-0.5", Term("word", weight=-0.5)), ("title/word", Term("word", field="title")), ("a\\b\\word", Term("word", field="a/b")),
    ('"two words"', Term("two words", "phrase")), ('title/"two words":3', Term("two words", "phrase", "title", weight=3.0)), ("price>=10", Term("10", "value", "price", ">=")),
    ("day<>2020", Term("2020", "value", "day", "<>")), ("box=[1,2]", Term("[1,2]", "value", "box", "=")), ("{a,b}", Term("{a,b}", "glob")),
])
def test_terms(token, want):
    assert parse_term(token) == want


def test_either_notation():
    assert parse("a1 b1 AND") == parse("a1 and b1") == Op("AND", (A, B)) and parse("a1 b1 c1") == Op("OR", (Op("OR", (A, B)), C))


@pytest.mark.parametrize("text,code", [("", 108), ("AND", 108), ("a1 AND", 108), ("(a1", 108), ("a1 (b1)", 108), ("a1 WITHIN", 108), ('""', 125)])
def test_errors(text, code):
    with pytest.raises(QueryError) as x:
        (parse_infix if "(" in text else parse_rpn)(text)
    assert x.value.code == code and str(code) in str(x.value)


def test_rewriting():
    n = lambda x: Op("NOT", (x,))
    assert rewrite(Op("AND", (A, n(B)))) == Op("ANDNOT", (A, B)) == rewrite(Op("AND", (n(B), A)))
    assert rewrite(n(Op("OR", (A, B)))) == Op("NOR", (A, B)) and rewrite(n(Op("AND", (A, B)))) == Op("NAND", (A, B)) and rewrite(n(Op("XOR", (A, B)))) == Op("XNOR", (A, B))
    assert rewrite(Op("BOOST", (Op("BOOST", (A,), "2"),), "3")) == Op("BOOST", (A,), "6.0")
    assert rewrite(Op("WITHIN", (Op("OR", (A, B)),), "t")) == Op("OR", (Term("a1", field="t"), Term("b1", field="t"))) and rewrite(Op("WITHIN", (A,), "2020")).name == "WITHIN"
    assert rewrite(Op("SIBLING", (Op("AND", (A, B)),))) == Op("PEER", (A, B)) and rewrite(Op("SIBLING", (Op("XOR", (A, B)),))).name == "EMPTY"
    with pytest.raises(QueryError):
        rewrite(Op("SIBLING", (Op("NOR", (A, B)),)))
    assert leaves(Op("AND", (A, Op("OR", (B, C))))) == [A, B, C]
    assert needs_hits(Op("NEAR", (A, B))) and not needs_hits(Op("AND", (A, B))) and needs_hits(Op("AND", (A, Op("PEER", (B, C)))))


words = st.sampled_from(["a1", "b1", "c1", "d1*", "*eee", "title/f1", "g1:2", '"two words"', "price>=3"]).map(parse_term)
trees = st.recursive(
    words,
    lambda t: st.one_of(
        st.tuples(st.sampled_from(["AND", "OR", "ANDNOT", "PEER", "NEAR", "MAYBE"]), t, t).map(lambda x: Op(x[0], x[1:])),
        st.tuples(st.sampled_from(["WITHIN", "BOOST", "REDUCE"]), t).map(lambda x: Op(x[0], (x[1],), "2")),
    ),
    max_leaves=8,
)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_round_trips(tree):
    assert parse_rpn(to_rpn(tree)) == tree and from_json(to_json(tree)) == tree


def test_operator_tokens():
    assert operator("NEAR>5") == ("AFTER", "5", None) and operator("PROX<5") == ("BEFORE", "5", None) and operator("near") is None and operator("near", True) == ("NEAR", None, None)
    assert operator(".=.") == ("PEER", None, None) and operator("HITCOUNT>=3") == ("HITCOUNT", "3", ">=") and operator("BUTNOT") == ("ANDNOT", None, None)


def test_builder():
    from hitweave.plans import word

    assert word("a1") & word("b1") | word("c1") == parse_rpn("a1 b1 AND c1 OR") and word("a1") - ~word("b1") == parse_rpn("a1 b1 NOT ANDNOT") and word("a1") ^ word("b1") == parse_rpn("a1 b1 XOR")
    assert word("a1").near(word("b1"), 5).within("t").boost(2) == parse_rpn("a1 b1 NEAR:5 WITHIN:t BOOST:2") and word("a1").peer(word("b1")).op("REDUCE", arg=2) == parse_rpn("a1 b1 PEER REDUCE:2")
    assert word("a1").before(word("b1")) == parse_rpn("a1 b1 BEFORE")
    for bad in (lambda: word("a1").op("NOPE"), lambda: word("a1").op("AND"), lambda: word("a1").op("NOT", word("b1"))):
        with pytest.raises(QueryError):
            bad()


def test_records_as_terms():
    assert parse_term("db//key-1") == Term("key-1", "record", "db") and parse_term("db//key-1/title:2") == Term("key-1/title", "record", "db", weight=2.0)
    assert parse_rpn(to_rpn(Term("k", "record", "db", weight=0.5))) == Term("k", "record", "db", weight=0.5)
