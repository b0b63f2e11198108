"""Typed values: numbers, money, dates with a precision, durations, truth, boxes and identifiers."""

from __future__ import annotations

import dataclasses
import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """A number, or null."""
    return column.try_cast("double")


def currency(column: Column) -> Column:
    """An amount as DECIMAL(18,4): ``$12.50``, ``12,50``, ``1.234,50``, ``99¢``; the last ``.`` or ``,`` before one or two digits at the end parts the fraction."""
    bare = F.regexp_replace(F.trim(column), r"[\s$£¥¤€]", "")
    cents = bare.endswith("¢")
    bare = F.regexp_replace(bare, "¢$", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,][0-9]{1,2}$", ""), "[.,]", "")
    part = F.regexp_extract(bare, r"[.,]([0-9]{1,2})$", 1)
    amount = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part)).try_cast("decimal(18,4)")
    ok = bare.rlike(r"^-?[0-9][0-9.,]*$|^[.,][0-9]{1,2}$")
    return F.when(ok, F.when(cents, (amount / 100).cast("decimal(18,4)")).otherwise(amount))


def boolean(column: Column) -> Column:
    """Truth as written: numbers by being other than 0, words by their first letters in several languages; all else is false."""
    v = F.lower(F.regexp_replace(column, r"\s", ""))
    n = v.try_cast("double")
    yes = v.rlike("^[tyjsem]") | (v.startswith("a") & ~v.startswith("aus") & ~v.startswith("apagado")) | v.rlike("^(on|oui|da)")
    return F.when(column.isNotNull(), F.when(n.isNotNull(), n != 0).otherwise(yes))


def number_range(column: Column) -> Column:
    """``[a,b]``, ``(a,b)``, ``a..b`` or ``a-b`` as a struct of lo and hi; null for anything else."""
    num = r"-?[0-9]+(?:\.[0-9]+)?"
    pattern = rf"^\s*[\[(]?\s*({num})\s*(?:,|\.\.|-)\s*({num})\s*[\])]?\s*$"
    lo, hi = (F.regexp_extract(column, pattern, n).try_cast("double") for n in (1, 2))
    return F.when(column.rlike(pattern), F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")))


_UNITS = {"sec": 1 / 60, "min": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200, "year": 525600}


def ttl_minutes(column: Column) -> Column:
    """A time to live in minutes: ``3 days``, ``2h``, ``90 min``; a bare number is minutes."""
    v = F.lower(F.trim(column))
    n = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)", 2)
    factor = F.when(unit == "", 1.0)
    for name, minutes in _UNITS.items():
        factor = factor.when(unit.startswith(name) | (unit == (name[0] if name not in ("min", "month") else {"min": "m", "month": "mo"}[name])), float(minutes))
    return F.round(n * factor).cast("int")


@dataclasses.dataclass(frozen=True)
class Span:
    """A date of some precision as what it covers: from ``lo`` to before ``hi``."""

    lo: datetime.datetime
    hi: datetime.datetime
    precision: str


def parse_date(text: str, today: datetime.date | None = None) -> Span | None:
    """``YYYY``, ``YYYYMM``, ``YYYYMMDD``, ISO dates and times, RFC-822 dates, and Today, Yesterday, Tomorrow and Now."""
    s = text.strip()
    day = datetime.timedelta(days=1)
    t = datetime.datetime

    def of_day(d: datetime.date) -> Span:
        lo = t(d.year, d.month, d.day)
        return Span(lo, lo + day, "day")

    word = s.lower()
    now = t.combine(today, datetime.time()) if today else t.now(datetime.UTC).replace(tzinfo=None)
    if word in ("today", "yesterday", "tomorrow"):
        return of_day(now.date() + day * {"today": 0, "yesterday": -1, "tomorrow": 1}[word])
    if word == "now":
        return Span(now, now + datetime.timedelta(seconds=1), "second")
    m = re.fullmatch(r"([0-9]{4})(?:[-/]?([0-9]{2})(?:[-/]?([0-9]{2}))?)?", s)
    try:
        if m:
            y, mo, d = (int(x) if x else None for x in m.groups())
            if mo is None:
                return Span(t(y, 1, 1), t(y + 1, 1, 1), "year")
            if d is None:
                return Span(t(y, mo, 1), t(y + mo // 12, mo % 12 + 1, 1), "month")
            return of_day(datetime.date(y, mo, d))
        m = re.fullmatch(r"([0-9]{4})-?([0-9]{2})-?([0-9]{2})[T ]([0-9]{2}):?([0-9]{2})(?::?([0-9]{2})(?:\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?", s)
        if m:
            y, mo, d, h, mi = map(int, m.groups()[:5])
            lo = t(y, mo, d, h, mi, int(m[6] or 0))
            if m[7] and m[7] != "Z":
                zone = int(m[7][1:3]) * 60 + int(m[7][-2:])
                lo -= datetime.timedelta(minutes=zone if m[7][0] == "+" else -zone)
            return Span(lo, lo + datetime.timedelta(seconds=1 if m[6] else 60), "second" if m[6] else "minute")
        from email.utils import parsedate_to_datetime

        lo = parsedate_to_datetime(s)
        lo = lo.astimezone(datetime.UTC).replace(tzinfo=None) if lo.tzinfo else lo
        return Span(lo, lo + datetime.timedelta(seconds=1), "second")
    except (ValueError, TypeError, IndexError):
        return None


def date_span(column: Column) -> Column:
    """The same over a column: a struct of lo, hi (past the end) and prec; null for what is no date."""
    c = F.regexp_replace(F.trim(column), r"[/]", "-")
    year, month = c.rlike(r"^[0-9]{4}$"), c.rlike(r"^[0-9]{4}-?[0-9]{2}$")
    day = c.rlike(r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}$")
    digits = F.regexp_replace(c, "-", "")
    full = F.when(year, F.concat(digits, F.lit("0101"))).when(month, F.concat(digits, F.lit("01"))).when(day, digits)
    lo = F.coalesce(F.try_to_timestamp(full, F.lit("yyyyMMdd")), F.when(full.isNull(), c.try_cast("timestamp")))
    prec = F.when(year, "year").when(month, "month").when(day, "day").otherwise("second")
    hi = (
        F.when(year, F.add_months(lo, 12).cast("timestamp"))
        .when(month, F.add_months(lo, 1).cast("timestamp"))
        .when(day, F.date_add(lo, 1).cast("timestamp"))
        .otherwise(lo + F.expr("INTERVAL 1 SECOND"))
    )
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), prec.alias("prec")))


def julian_day(column: Column) -> Column:
    """The Julian day number of a date."""
    return F.datediff(column, F.lit("1970-01-01").cast("date")) + F.lit(2_440_588)


def added(column: Column, n: Column | int, unit: str) -> Column:
    """A date or time ``n`` units later: seconds, minutes, hours, days, weeks, months or years."""
    n, unit = n if isinstance(n, Column) else F.lit(n), unit.lower().rstrip("s")
    if unit in ("month", "year"):
        return column + F.make_ym_interval(F.lit(0), n.cast("int") * (12 if unit == "year" else 1))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit]
    return column.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n.cast("long") * seconds).cast("decimal(18,6)"))


def latitude_longitude(column: Column) -> Column:
    """``52.5N``, ``13 24 30 E`` or a signed number as degrees."""
    pattern = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)[°\s]*(?:([0-9]+(?:\.[0-9]+)?)['′\s]*)?(?:([0-9]+(?:\.[0-9]+)?)[\"″\s]*)?([NSEWnsew]?)\s*$"
    d, m, s = (F.regexp_extract(column, pattern, k).try_cast("double") for k in (1, 2, 3))
    size = F.abs(d) + F.coalesce(m, F.lit(0.0)) / 60 + F.coalesce(s, F.lit(0.0)) / 3600
    low = F.upper(F.regexp_extract(column, pattern, 4)).isin("S", "W") | (d < 0)
    return F.when(column.rlike(pattern), F.when(low, -size).otherwise(size))


def box(column: Column) -> Column:
    """``N,W,S,E`` with or without brackets or ``RECT``, as a struct of n, w, s and e."""
    num = r"\s*(-?[0-9]+(?:\.[0-9]+)?)\s*"
    pattern = rf"^\s*(?i:rect)?\s*[\[({{<]?{num},{num},{num},{num}[\])}}>]?\s*$"
    n, w, s, e = (F.regexp_extract(column, pattern, k).try_cast("double") for k in (1, 2, 3, 4))
    return F.when(column.rlike(pattern), F.struct(n.alias("n"), w.alias("w"), s.alias("s"), e.alias("e")))


def card_valid(column: Column) -> Column:
    """Whether the digits of a card number pass the check."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(column, r"[ -]", "")), F.lit(False))


def isbn_valid_text(text: str) -> bool:
    s = re.sub(r"[\s-]", "", text).upper()
    if re.fullmatch(r"[0-9]{9}[0-9X]", s):
        return sum((10 - n) * (10 if c == "X" else int(c)) for n, c in enumerate(s)) % 11 == 0
    return bool(re.fullmatch(r"97[89][0-9]{10}", s)) and sum((3 if n % 2 else 1) * int(c) for n, c in enumerate(s)) % 10 == 0


def iban_valid_text(text: str) -> bool:
    s = re.sub(r"\s", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def isbn_valid(column: Column) -> Column:
    @F.pandas_udf("boolean")
    def valid(values):
        return values.map(lambda v: v is not None and isbn_valid_text(v)).astype(bool)

    return valid(column)


def iban_valid(column: Column) -> Column:
    @F.pandas_udf("boolean")
    def valid(values):
        return values.map(lambda v: v is not None and iban_valid_text(v)).astype(bool)

    return valid(column)


def dotnumber(column: Column) -> Column:
    """An IPv4 address or a dotted number of up to four parts as one number that sorts like it."""
    parts = F.split(column, r"\.")
    ok = column.rlike(r"^[0-9]{1,5}(\.[0-9]{1,5}){0,3}$")
    value = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0).cast("long"), lambda a, i: a * 65536 + F.coalesce(F.try_element_at(parts, i + 1).try_cast("long"), F.lit(0)))
    return F.when(ok, value)


def guess_type(value: str) -> str:
    """The type of a field by its first value: box, range, date, number, dotnumber or text, tried in this order."""
    s = value.strip()
    num = r"-?[0-9]+(?:\.[0-9]+)?"
    if re.fullmatch(rf"(?i:rect)?\s*[\[({{<]?\s*{num}\s*(?:,\s*{num}\s*){{3}}[\])}}>]?", s):
        return "box"
    if re.fullmatch(rf"[\[(]\s*{num}\s*,\s*{num}\s*[\])]|{num}\s*\.\.\s*{num}", s):
        return "range"
    if re.fullmatch(r"[0-9]{4}[-/][0-9]{2}([-/][0-9]{2}([T ].*)?)?", s) and parse_date(s):
        return "date"
    if re.fullmatch(r"[0-9]{8}", s) and int(s) > 19000101 and parse_date(s):
        return "date"
    if re.fullmatch(num, s):
        return "number"
    if re.fullmatch(r"[0-9]+(\.[0-9]+){2,3}", s):
        return "dotnumber"
    return "text"
