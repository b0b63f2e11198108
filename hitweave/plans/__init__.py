"""Query languages, rewriting, and the compiler from queries to DataFrames."""

from .compiler import Engine, search, search_smart
from .errors import QueryError
from .syntax import Op, Term, parse, parse_infix, parse_rpn, to_rpn, word

__all__ = ["Engine", "Op", "QueryError", "Term", "parse", "parse_infix", "parse_rpn", "search", "search_smart", "to_rpn", "word"]
