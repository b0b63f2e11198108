"""Words, globs and strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of ASCII letters and digits, the same in Java, Python and RE2.
ASCII_WORD = "[a-z0-9]+"
#: Words of any script; a full stop before a letter joins (``domain.de``), as do inner apostrophes.
UNICODE_WORD = r"[^\W_]+(?:(?:['’]|\.(?=[^\W\d_]))[^\W_]+)*"


def glob_to_regex(glob: str) -> str:
    """``*``, ``?``, ``[abc]``, ``[!a-c]`` and ``{x,y}`` as a regular expression for a whole string."""
    out, depth, at = [], 0, 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "\\" and at < len(glob):
            out.append(re.escape(glob[at]))
            at += 1
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 1)
            body = glob[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            at = end + 1
        elif c == "{" and "}" in glob[at:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
    return f"^(?s:{''.join(out)})$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[{")


def matches_glob(column: Column, glob: str, fold: bool = False) -> Column:
    """Whether the whole value matches; false for null, and in any case where ``fold``."""
    pattern = glob_to_regex(glob.lower() if fold else glob)
    return F.coalesce((F.lower(column) if fold else column).rlike(pattern), F.lit(False))


def field_glob(glob: str) -> str:
    """A field name or path as a glob over normal paths: lower-case, with ``/`` for all separators."""
    return re.sub(r"[\\|/]+", "/", glob).strip("/").lower()


def packed(column: Column) -> Column:
    """Trimmed, without quotes around it, with white space packed."""
    return F.regexp_replace(F.regexp_replace(F.trim(column), r"^[\"'](.*)[\"']$", "$1"), r"\s+", " ")


def exact_hash(column: Column) -> Column:
    """The hash of a hash field: equal for equal packed values."""
    return F.xxhash64(packed(column))


def case_hash(column: Column) -> Column:
    """The hash of a casehash field: equal for values that are equal but for case."""
    return F.xxhash64(F.lower(packed(column)))


def lexi(column: Column) -> Column:
    """The sort key of a lexi field: its first eight characters in lower case."""
    return F.lower(F.substring(packed(column), 1, 8))


def ratcliff(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity, from 0 to 1."""

    @F.pandas_udf("double")
    def similarity(x, y):
        import difflib

        import pandas as pd

        return pd.Series(
            [None if s is None or t is None else difflib.SequenceMatcher(None, s, t, autojunk=False).ratio() for s, t in zip(x, y, strict=True)], dtype="float64"
        )

    return similarity(a, b)


def decoded_entities(column: Column) -> Column:
    """Character references replaced by what they stand for."""

    @F.pandas_udf("string")
    def decode(values):
        import html

        return values.map(html.unescape, na_action="ignore")

    return decode(column)


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data: bytes) -> str:
    """Base58 with the alphabet without 0, O, I and l."""
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, digit = divmod(n, 58)
        out = _BASE58[digit] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def unbase58(text: str) -> bytes:
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base58_column(column: Column) -> Column:
    """Base58 of a string's bytes."""

    @F.pandas_udf("string")
    def encode(values):
        return values.map(lambda v: base58(v.encode()), na_action="ignore")

    return encode(column)


def crc64(data: bytes) -> int:
    """CRC-64 with the ECMA-182 polynomial, reflected (as in XZ)."""
    crc = 0xFFFFFFFFFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0xC96C5795D7870F42 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFFFFFFFFFF
