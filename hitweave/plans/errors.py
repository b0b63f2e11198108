"""Diagnostics, numbered as in the Z39.50 bib-1 set."""

from __future__ import annotations

MESSAGES = {
    3: "unsupported search", 4: "terms are all stopwords", 9: "truncated word too short", 32: "resources exhausted", 108: "malformed query",
    110: "operator unsupported", 113: "unsupported attribute type", 114: "unsupported use attribute", 117: "unsupported relation attribute",
    125: "malformed search term", 135: "operands cannot be siblings",
}


class QueryError(ValueError):
    """A query that can't be run; ``code`` is its diagnostic."""

    def __init__(self, code: int, detail: str = ""):
        self.code = code
        super().__init__(f"{code} {MESSAGES.get(code, 'error')}" + f": {detail}" * bool(detail))
