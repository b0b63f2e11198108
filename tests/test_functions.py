"""Scalar functions against plain values."""

import datetime

import pytest
from pyspark.sql import functions as F

from hitweave.functions import phonetic, values
from hitweave.functions import text as T


def column(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], f"n int, v {kind}")
    return [r.x for r in df.select("n", f(F.col("v")).alias("x")).orderBy("n").collect()]


def test_currency(spark):
    got = column(spark, values.currency, ["$12.50", "12,50", "99¢", "£1.234,50", "1,234", "¥500", "free", None, ",5"])
    assert [None if x is None else float(x) for x in got] == [12.5, 12.5, 0.99, 1234.5, 1234.0, 500.0, None, None, 0.5]


def test_boolean(spark):
    got = column(spark, values.boolean, ["true", "Yes", "ja", "sí", "1", "0", "no", " T ", "aus", "an", "oui", "off", None])
    assert got == [True, True, True, True, True, False, False, True, False, True, True, False, None]


def test_ranges_boxes_and_ttl(spark):
    assert [tuple(x) if x else None for x in column(spark, values.number_range, ["[1,2]", "(3.5, 2)", "1..9", "4-7", "x", "5"])] == [(1, 2), (2, 3.5), (1, 9), (4, 7), None, None]
    assert [tuple(x) if x else None for x in column(spark, values.box, ["1,2,3,4", "RECT{50,-10,40.5,5}", "[1,2,3]"])] == [(1, 2, 3, 4), (50, -10, 40.5, 5), None]
    assert column(spark, values.ttl_minutes, ["3 days", "2h", "90 min", "15", "1 week", "120 seconds", "x"]) == [4320, 120, 90, 15, 10080, 2, None]
    assert column(spark, values.dotnumber, ["10.0.0.1", "x", "1.2"])[1] is None


def test_dates(spark):
    d = datetime.datetime
    assert values.parse_date("1999") == values.Span(d(1999, 1, 1), d(2000, 1, 1), "year") and values.parse_date("199912") == values.Span(d(1999, 12, 1), d(2000, 1, 1), "month")
    assert values.parse_date("2000-02-29").hi == d(2000, 3, 1) and values.parse_date("20010230") is None and values.parse_date("rubbish") is None
    assert values.parse_date("2020-01-02T03:04:05+02:00").lo == d(2020, 1, 2, 1, 4, 5) and values.parse_date("Mon, 02 Mar 2020 10:00:00 +0000").lo == d(2020, 3, 2, 10)
    assert values.parse_date("yesterday", datetime.date(2020, 3, 1)).lo == d(2020, 2, 29)
    got = column(spark, values.date_span, ["1999", "1999-06", "2000/02/29", "2020-01-02 03:04:05", "x", "20010230"])
    assert [(x.lo, x.hi, x.prec) if x else None for x in got] == [
        (d(1999, 1, 1), d(2000, 1, 1), "year"), (d(1999, 6, 1), d(1999, 7, 1), "month"), (d(2000, 2, 29), d(2000, 3, 1), "day"), (d(2020, 1, 2, 3, 4, 5), d(2020, 1, 2, 3, 4, 6), "second"), None, None,
    ]


@pytest.mark.parametrize("value,kind", [("1,2,3,4", "box"), ("[1,2]", "range"), ("2020-01-02", "date"), ("20200102", "date"), ("12345678", "number"), ("3.5", "number"), ("1.2.3", "dotnumber"), ("words", "text")])
def test_guessing(value, kind):
    assert values.guess_type(value) == kind


def test_identifiers(spark):
    assert column(spark, values.card_valid, ["4111 1111 1111 1111", "4111111111111112", None]) == [True, False, False]
    assert column(spark, values.isbn_valid, ["0-306-40615-2", "978-3-16-148410-0", "0306406153", "x"]) == [True, True, False, False]
    assert column(spark, values.iban_valid, ["DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]) == [True, False]


def test_globs(spark):
    import re

    for glob, yes, no in (("a*b", "axxb", "axxc"), ("a?c", "abc", "ac"), ("[ab]x", "bx", "cx"), ("[!ab]x", "cx", "ax"), ("{one,t*o}", "twoo", "three"), ("a.b", "a.b", "axb"), ("x\\*", "x*", "xy")):
        pattern = T.glob_to_regex(glob)
        assert re.match(pattern, yes) and not re.match(pattern, no), glob
        assert column(spark, lambda c, g=glob: T.matches_glob(c, g), [yes, no, None]) == [True, False, False]
    assert T.field_glob("A\\b|C/") == "a/b/c"


def test_hashes_and_strings(spark):
    a, b, c = column(spark, T.exact_hash, ["'a  b'", "a b", "A b"])
    assert a == b != c
    x, y = column(spark, T.case_hash, ["A b", " a   B "])
    assert x == y and column(spark, T.lexi, ["ABCDEFGHIJ"]) == ["abcdefgh"]
    assert column(spark, lambda c: T.ratcliff(c, F.lit("abcd")), ["abcd", "bcde", ""]) == [1.0, 0.75, 0.0] and column(spark, T.decoded_entities, ["&lt;&eacute;", None]) == ["<é", None]
    assert T.crc64(b"123456789") == 0x995DC9BBDF1939FA and T.base58(b"Hello World!") == "2NEpo7TZRRrLZSi2U" and T.unbase58("2NEpo7TZRRrLZSi2U") == b"Hello World!"
    assert T.unbase58(T.base58(b"\0\0x")) == b"\0\0x" and column(spark, T.base58_column, ["Hello World!"]) == ["2NEpo7TZRRrLZSi2U"]


def test_sounds(spark):
    assert [phonetic.soundex_text(w) for w in ("Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "")] == ["R163", "R163", "A261", "T522", "P236", ""]
    assert column(spark, phonetic.soundex, ["Robert", "Ashcraft"]) == ["R163", "A261"] and column(spark, lambda c: phonetic.soundex(c, 6), ["Robert"]) == ["R16300"]
    for one, two in (("Smith", "Smyth"), ("Stephen", "Steven"), ("Philip", "Filip"), ("night", "nite"), ("Catherine", "Kathryn"), ("knight", "night"), ("Schmidt", "Smith")):
        assert set(phonetic.metaphones_text(one)) & set(phonetic.metaphones_text(two)), (one, two)
    assert not set(phonetic.metaphones_text("garden")) & set(phonetic.metaphones_text("window"))
    apart = lambda a, b: abs(phonetic.eudex_distance_text(a, b))
    assert phonetic.eudex_text("") == 0 and apart("same", "same") == 0 < apart("jumpo", "jumbo") < apart("jumpo", "horse")
    # worked out by hand: J, then u (odd after even), m (even), p (odd), none of o's bits change
    assert phonetic.eudex_text("Jumpo") == 0x03 << 56 | 1 << 24 | 2 << 16 | 73 << 8 == phonetic.eudex_text("jumpo")
    assert phonetic.eudex_text("jumbo") == 0x03 << 56 | 1 << 8 | 2
    assert phonetic.eudex_distance_text("b", "a") == -phonetic.eudex_distance_text("a", "b") == -34 * (36 ^ 132).bit_count()
    assert phonetic.eudex_text("i-1") == 248 << 56
    assert column(spark, lambda c: phonetic.eudex_distance(c, F.lit("ring")), ["ring", None]) == [0, None]


def test_date_arithmetic(spark):
    df = spark.sql("SELECT timestamp'2000-01-31 12:00:00' AS d")
    d = datetime.datetime
    for n, unit, want in ((1, "months", d(2000, 2, 29, 12)), (-1, "year", d(1999, 1, 31, 12)), (2, "weeks", d(2000, 2, 14, 12)), (90, "minutes", d(2000, 1, 31, 13, 30)), (-1, "second", d(2000, 1, 31, 11, 59, 59))):
        assert df.select(values.added(F.col("d"), n, unit).alias("x")).first().x == want, unit
    assert df.select(values.julian_day(F.col("d")).alias("x")).first().x == 2451575


def test_places(spark):
    got = column(spark, values.latitude_longitude, ["52.5N", "13 30 E", "12 30 36 S", "-7.25", "0°30'W", "x"])
    assert [None if x is None else round(x, 6) for x in got] == [52.5, 13.5, -12.51, -7.25, -0.5, None]
