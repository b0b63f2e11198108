"""Phonetic codes: Soundex, a Metaphone with two codes, and Eudex-like hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = frozenset("AEIOU")


def soundex_text(word: str, length: int = 4) -> str:
    """Soundex of ASCII letters: the first letter and digits of the consonants, h and w don't part equal ones."""
    codes = {c: d for d, cs in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in cs}
    letters = [c for c in word.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    out, last = letters[0], codes.get(letters[0], "")
    for c in letters[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "0" * length)[:length]


def metaphones_text(word: str) -> tuple[str, str]:
    """Primary and secondary code of a word after the rules of Double Metaphone for English and common loan spellings.

    Four sounds at most, as usual; the codes are equal where there is no second
    pronunciation.
    """
    w = "".join(c for c in word.upper() if c.isalpha())
    for a, b in (("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("ß".upper(), "SS"), ("É", "E"), ("È", "E"), ("Ê", "E"), ("Ç", "S"), ("Ñ", "N")):
        w = w.replace(a, b)
    first, second = [], []

    def add(a: str, b: str | None = None) -> None:
        first.append(a)
        second.append(a if b is None else b)

    n, at = len(w), 0
    if w[:2] in ("GN", "KN", "PN", "WR", "PS"):
        at = 1
    if w[:1] == "X":
        add("S")
        at = 1
    while at < n and len("".join(first)) < 4:
        c, two, three, before = w[at], w[at : at + 2], w[at : at + 3], w[at - 1] if at else ""
        step = 2 if two == c * 2 and c not in "C" else 1
        if c in "AEIOUY":
            if at == 0:
                add("A")
            step = 1
        elif c == "B":
            if not (at == n - 1 and before == "M"):
                add("P")
        elif c == "C":
            if three == "CIA":
                add("X")
                step = 3
            elif two == "CH":
                add("K" if at == 0 and w[at + 2 : at + 3] in tuple("RLNAO") and w[at : at + 5] in ("CHARA", "CHARI", "CHORE", "CHEMI", "CHORU") or three in ("CHR", "CHL") else "X", "K")
                step = 2
            elif two == "CK" or two == "CQ":
                add("K")
                step = 2
            elif two == "CC" and w[at + 2 : at + 3] in tuple("IEH"):
                add("KS")
                step = 3
            elif two in ("CI", "CE", "CY"):
                add("S")
                step = 2
            else:
                add("K")
                step = 2 if two == "CC" else 1
        elif c == "D":
            if two == "DG" and w[at + 2 : at + 3] in tuple("IEY"):
                add("J")
                step = 3
            else:
                add("T")
                step = 2 if two in ("DT", "DD") else 1
        elif c == "F":
            add("F")
        elif c == "G":
            if two == "GH":
                if at == 0:
                    add("J" if w[2:3] == "I" else "K")
                elif before in _VOWELS and w[max(0, at - 3) : at - 2] not in tuple("BDH"):
                    if before == "U" and w[max(0, at - 3) : at - 2] in tuple("CGLRT"):
                        add("F")
                elif before not in _VOWELS:
                    add("K")
                step = 2
            elif two == "GN":
                add("KN" if at == 1 and w[0] in _VOWELS else "N", "N" if not (at == 1 and w[0] in _VOWELS) else "N")
                step = 2
            elif w[at + 1 : at + 2] in tuple("IEY"):
                add("J", "K")
                step = 2
            else:
                add("K")
        elif c == "H":
            if (at == 0 or before in _VOWELS) and w[at + 1 : at + 2] in _VOWELS and w[at + 1 : at + 2]:
                add("H")
        elif c == "J":
            add("J", "A" if at == 0 else "H") if at == 0 else add("J", "H")
        elif c == "K":
            add("K")
        elif c == "L":
            add("L")
        elif c == "M":
            add("M")
        elif c == "N":
            add("N")
        elif c == "P":
            if two == "PH":
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if two in ("PP", "PB") else 1
        elif c == "Q":
            add("K")
        elif c == "R":
            if at == n - 1 and w[max(0, at - 2) : at] == "IE" and w[max(0, at - 4) : at - 2] not in ("ME", "MA"):
                add("", "R")
            else:
                add("R")
        elif c == "S":
            if three in ("SIO", "SIA"):
                add("S", "X")
                step = 3
            elif two == "SH":
                add("X")
                step = 2
            elif two == "SC":
                if w[at + 2 : at + 3] == "H":
                    after = w[at + 3 : at + 5]
                    if after in ("ER", "EN"):
                        add("X", "SK")
                    elif after in ("OO", "UY", "ED", "EM"):
                        add("SK")
                    elif at == 0 and after[:1] and after[0] not in "AEIOUYW":
                        add("X", "S")
                    else:
                        add("X")
                    step = 3
                elif w[at + 2 : at + 3] in tuple("IEY"):
                    add("S")
                    step = 3
                else:
                    add("SK")
                    step = 3 if three == "SCC" else 2
            elif two == "SZ" or at == 0 and two in ("SM", "SN", "SL", "SW"):
                add("S", "X")
                step = 2 if two == "SZ" else 1
            else:
                add("S")
                step = 2 if two in ("SS", "SZ") else 1
        elif c == "T":
            if w[at : at + 4] == "TION" or three in ("TIA", "TCH"):
                add("X")
                step = 3
            elif two == "TH":
                add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if two in ("TT", "TD") else 1
        elif c == "V":
            add("F")
        elif c == "W":
            if two == "WR":
                add("R")
                step = 2
            elif at == 0 and w[1:2] in _VOWELS and w[1:2]:
                add("A", "F")
            elif at == 0 and two == "WH":
                add("A")
        elif c == "X":
            add("KS")
        elif c == "Z":
            if two == "ZH":
                add("J")
                step = 2
            else:
                add("S", "TS" if before and before != "T" and w[at + 1 : at + 2] in tuple("OIA") and w[at + 1 : at + 2] else "S")
        at += step
    return "".join(first)[:4], "".join(second)[:4]


def soundex(column: Column, length: int = 4) -> Column:
    """Soundex; Spark's own for four characters."""
    if length == 4:
        return F.soundex(column)

    @F.pandas_udf("string")
    def code(values):
        return values.map(lambda v: soundex_text(v, length), na_action="ignore")

    return code(column)


def metaphones(column: Column) -> Column:
    """``array(primary, secondary)``."""

    @F.pandas_udf("array<string>")
    def code(values):
        return values.map(lambda v: list(metaphones_text(v)), na_action="ignore")

    return code(column)


# Fixed values of the Eudex hash: the sounds of the letters a to z as bits, within a word and as its first
# letter, and the weights of the bytes in a distance, from the last letter to the first.
EUDEX_LETTERS = (0, 72, 12, 24, 0, 68, 8, 4, 1, 5, 9, 160, 2, 18, 0, 73, 168, 161, 20, 29, 1, 69, 0, 132, 1, 148)
EUDEX_FIRST = (132, 36, 6, 12, 216, 34, 4, 2, 248, 3, 5, 80, 1, 9, 148, 37, 84, 81, 10, 14, 224, 35, 0, 66, 228, 74)
EUDEX_WEIGHTS = (1, 2, 3, 5, 8, 13, 21, 34)


def _letter(char: str) -> int | None:
    """A letter's place in the alphabet, by the low byte of its code and without regard to case."""
    place = ((ord(char) | 32) - ord("a")) & 0xFF
    return place if place < 26 else None


def eudex_text(word: str) -> int:
    """A 64-bit hash of the sounds: the first letter in the top byte, and the last of up to eight others.

    Of these a letter counts where its lowest bit differs from that of the one before.
    """
    if not word:
        return 0
    first = _letter(word[0]) if ord(word[0]) <= 0xFF else None
    out = taken = 0
    for char in word[1:]:
        if taken == 8:
            break
        place = _letter(char)
        if place is not None and (EUDEX_LETTERS[place] ^ out) & 1:
            out = (out << 8 | EUDEX_LETTERS[place]) & (1 << 64) - 1
            taken += 1
    return out | (0 if first is None else EUDEX_FIRST[first]) << 56


def eudex_distance_text(a: str, b: str) -> int:
    """Differing bits by weight, those of earlier letters weighing more; negative unless the first hash is the larger."""
    x, y = eudex_text(a), eudex_text(b)
    apart = sum(((x ^ y) >> 8 * n & 0xFF).bit_count() * w for n, w in enumerate(EUDEX_WEIGHTS))
    return apart if x > y else -apart


def eudex_distance(a: Column, b: Column) -> Column:
    @F.pandas_udf("long")
    def distance(x, y):
        import pandas as pd

        return pd.Series([None if s is None or t is None else eudex_distance_text(s, t) for s, t in zip(x, y, strict=True)], dtype="Int64")

    return distance(a, b)
