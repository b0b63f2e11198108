"""PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern and confirmed by what makes them valid:
card numbers and IBANs by their check digits, addresses by their ranges, dates by
the calendar.  Each is replaced by another value of the same format, the image
under a keyed permutation: a Feistel network over two halves of a number, walked
on until the image is in the format's domain.  Equal values (of one kind) have
equal pseudonyms in all documents, and who has the key can reverse them.

What makes values equal: addresses without regard to case, card numbers, IBANs
and SSNs without regard to how they are grouped, dates in any notation (but for
the few whose image the notation can't write).  Of phone numbers the country code
stays, and where it ends shows in the writing alone: two ways of writing a number
are linked if the code is set apart in both or in neither.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import extended, free

#: Rounds of the network.
ROUNDS = 8


def permuted(key: bytes, tweak: bytes, value: int, size: int, back: bool = False) -> int:
    """The image of ``value`` under a permutation of ``range(size)`` that key and tweak choose; ``back`` gives the preimage.

    A Feistel network over numbers of an even number of bits, applied again
    while the image is outside of the range.
    """
    if not 0 <= value < size:
        raise ValueError(f"{value} is not below {size}")
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, wide = (1 << half) - 1, (half + 7) // 8
    bound = size.to_bytes((size.bit_length() + 7) // 8, "big")
    head = b"".join(len(part).to_bytes(4, "big") + part for part in (tweak, bound))

    def f(n: int, x: int) -> int:
        given, out = head + bytes([n]) + x.to_bytes(wide, "big"), b""
        while len(out) < wide:  # a digest for each 256 bits of the half
            out += hmac.digest(key, given + (len(out) // 32).to_bytes(4, "big"), hashlib.sha256)
        return int.from_bytes(out[:wide], "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for n in reversed(range(ROUNDS)):
                left, right = right ^ f(n, left), left
        else:
            for n in range(ROUNDS):
                left, right = right, left ^ f(n, right)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that the digits ask for."""
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if n % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _into(shape: str, values: Iterable[str]) -> str:
    """The shape with its alphanumeric characters replaced in turn."""
    it = iter(values)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(key, kind, text, digits, back, keep, low, high):
    """Permutes all digits but the first ``keep``; the rest's first is from ``low`` to below ``high``."""
    head, rest = digits[:keep], digits[keep:]
    floor = low * 10 ** (len(rest) - 1)
    size = high * 10 ** (len(rest) - 1) - floor
    got = permuted(key, kind.encode() + head.encode(), int(rest) - floor, size, back) + floor
    return _into(text, head + str(got).zfill(len(rest)))


def _card(key, text, back):
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    first, new = digits[0], digits[:-1]  # the first digit tells the kind of card
    while True:  # a number of equal digits is no card
        got = permuted(key, b"card" + first.encode() + bytes([len(digits)]), int(new[1:]), 10 ** (len(new) - 1), back)
        new = first + str(got).zfill(len(new) - 1)
        if len(set(new + str(luhn(new)))) > 1:
            return _into(text, new + str(luhn(new)))


def _phone(key, text, back):
    plus = text.startswith("+")
    digits = re.sub(r"\D", "", text)
    if not 10 <= len(digits) <= 15:
        return None
    country = len(re.match(r"\+(\d{1,3})", text)[1]) if plus and re.match(r"\+\d{1,3}[ .\-(]", text) else 1 if plus else 0
    # area codes of ten-digit numbers start with 2 to 9; where one doesn't, nor does its pseudonym
    low, high = (0, 10) if len(digits) - country != 10 else (2, 10) if digits[country] >= "2" else (0, 2)
    return _digits(key, "phone", text, digits, back, country, low, high)


def _ssn(key, text, back):
    a, b, c = map(int, re.split(r"[- ]", text))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    area = a - 1 - (a > 666)
    got = permuted(key, b"ssn", (area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, back)
    c, got = got % 9999 + 1, got // 9999
    b, area = got % 99 + 1, got // 99 + 1
    return f"{area + (area >= 666):03d}{text[3]}{b:02d}{text[6]}{c:04d}"


#: Addresses that are the same for all: 0.0.0.0, 127.0.0.1 and 255.255.255.255.
_NOBODY = frozenset((0, 0x7F000001, 0xFFFFFFFF))


def _ip(key, text, back):
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    if value in _NOBODY:
        return None
    while True:  # addresses of nobody aren't given out
        value = permuted(key, b"ip", value, 1 << 32, back)
        if value not in _NOBODY:
            return ".".join(map(str, value.to_bytes(4, "big")))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(key, text, back):
    plain = re.sub(r"\s", "", text)
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = plain[4:]
    new = _classes(key, b"iban" + plain[:2].encode(), body, back)
    check = 98 - _mod97(new + plain[:2] + "00")
    return _into(text, plain[:2] + f"{check:02d}" + new)


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(key, kind, text, back):
    """Permutes texts of one pattern of digits, small and capital ASCII letters among themselves; other characters stay."""
    sets = [next((s for s in _SETS if c in s), None) for c in text]
    size = value = 0
    for c, s in zip(text, sets, strict=True):
        if s:
            size, value = (size or 1) * len(s), value * len(s) + s.index(c)
    if not size:
        return text
    pattern = "".join("x" if s is None else str(_SETS.index(s)) for s in sets)
    got, out = permuted(key, kind + pattern.encode(), value, size, back), []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            got, n = divmod(got, len(s))
            out.append(s[n])
        else:
            out.append(c)
    return "".join(reversed(out))


#: Characters of an address at most; what is longer is none.
ADDRESS = 1024


def _email(key, text, back):
    if len(text) > ADDRESS:
        return None
    # the top-level domain stays, so that the address stays one; capitals stay where they are
    rest, _, top = text.rpartition(".")
    both = _classes(key, b"email", rest.lower(), back)
    return "".join(n.upper() if o.isupper() else n for o, n in zip(rest, both, strict=True)) + f".{top}"


#: The years whose dates have their images among themselves.
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(key, text, back):
    m = re.fullmatch(r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))", text)
    if m[1]:
        year, month, day, sign, order = m[1], m[3], m[4], m[2], "ymd"
    else:
        year, sign, order = m[8], m[6], "dmy" if m[6] == "." or int(m[7]) <= 12 < int(m[5]) or (int(m[7]) <= 12 and m[6] != "/") else "mdy"
        day, month = (m[5], m[7]) if order == "dmy" else (m[7], m[5])
    try:
        n = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    near = _FIRST <= n <= _LAST
    low, high = (_FIRST, _LAST) if near else (1, datetime.date.max.toordinal())
    short = len(month) == 1 or len(day) == 1
    # a format's own dates among themselves: what is written must read as the same format again
    while True:
        n = permuted(key, b"date" + bytes([near]), n - low, high - low + 1, back) + low
        d = datetime.date.fromordinal(n)
        if not near and _FIRST <= n <= _LAST:
            continue
        if d.day <= 12 and (order, sign) in (("dmy", "/"), ("mdy", "-")):
            continue
        if short and d.month > 9 and d.day > 9:
            continue
        break
    mm, dd = (str(d.month), str(d.day)) if short else (f"{d.month:02d}", f"{d.day:02d}")
    return sign.join({"y": f"{d.year:04d}", "m": mm, "d": dd}[x] for x in order)


#: (kind, pattern, what gives the pseudonym or None where the value isn't valid), in the order in which they take a place.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    # the run of characters before the @ is read once, from its first letter or digit on
    ("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<at>[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\w./-])(?:[0-9]{4}(?P<d1>[-/.])[0-9]{1,2}(?P=d1)[0-9]{1,2}|[0-9]{1,2}(?P<d2>[-/.])[0-9]{1,2}(?P=d2)[0-9]{4})(?:(?=T[0-9]{2}:)|(?![\w/-]|\.[0-9]))", _date),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ip),
    ("card", r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])", _card),
    ("ssn", r"(?<![\w.-])[0-9]{3}(?P<s1>[- ])[0-9]{2}(?P=s1)[0-9]{4}(?![\w-]|\.[0-9])", _ssn),
    ("phone", r"(?<![\w.])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){1,6}[0-9](?![\w])|(?<![\w.+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])", _phone),
)


_MAKERS = {kind: maker for kind, _, maker in KINDS}
_ORDER = list(_MAKERS)


def _patterns() -> dict[str, re.Pattern]:
    """Each kind's pattern, and under the empty name all of them as alternatives."""
    out = {kind: re.compile(pattern) for kind, pattern, _ in KINDS}
    out[""] = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS))
    return out


_GATE = re.compile(r"[0-9@]")


def pseudonymise(
    text: str, key: bytes, back: bool = False, patterns: dict[str, re.Pattern] | None = None, known: dict | None = None
) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, end) of each in the given text.

    ``known`` keeps pseudonyms from one text to the next.
    """
    if not _GATE.search(text):
        return text, []
    patterns, known = patterns or _patterns(), {} if known is None else known
    out, found, at, search = [], [], 0, 0
    while (m := patterns[""].search(text, search)) is not None:
        first = next(k for k in _ORDER if m.group(k) is not None)
        new, start = None, m.start("at") if first == "email" else m.start()
        for kind in _ORDER[_ORDER.index(first) :]:  # what isn't valid as one kind may be of another at the same place
            value = text[start : m.end()] if kind == first else (again := patterns[kind].match(text, start)) and again.group()
            if not value:
                continue
            if (kind, value) not in known:
                if len(known) > 100_000:
                    known.clear()
                known[kind, value] = _MAKERS[kind](key, value, back)
            new = known[kind, value]
            if new is not None:
                break
        if new is None:
            search = start + 1
            continue
        out += [text[at:start], new]
        at = search = start + len(value)
        found.append((kind, start, at))
    return "".join([*out, text[at:]]), found


def _replaced(batches, key, back):
    import pyarrow as pa

    patterns, known = _patterns(), {}
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, found = [], []
        for x in batch.column(0):
            text = x.as_py()
            new, hits = (None, []) if text is None else pseudonymise(text, key, back, patterns, known)
            texts.append(new)
            found.append([{"kind": k, "start": s, "end": e} for k, s, e in hits])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(found, spans)], [*batch.schema.names[1:], "text", "found"])


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", carry: Iterable[str] = ("doc_id",), back: bool = False, suffix: str = "") -> DataFrame:
    """``(*carry, text, found)`` for every row of ``docs``: the whole text with its personal values replaced.

    ``found``: kind and place (in characters of the text given) of each value.
    Texts without any stay as they are; a null text stays null.  ``back``
    reverses the pseudonyms.  Rows repeated in ``docs`` each give a row.
    Nothing is shuffled.  ``suffix`` ends the names of the two columns, which
    give way to carried ones of their names by underscores.
    """
    carry = list(carry)
    out = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = extended(out, 1, "text string, found array<struct<kind:string,start:long,end:long>>")
    got = out.mapInArrow(lambda b: _replaced(b, key, back), schema)
    names = free(("text", "found"), carry, suffix)
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(n) for c, n in zip(("text", "found"), names, strict=True)])
