"""Formats: how a file falls into records, and a record into fields.

A format is a function from a file's text (or bytes, where it is ``binary``) to
``Parsed`` records.  Places count characters of the record's own text.  New formats
are added with ``register``.
"""

from __future__ import annotations

import csv as csv_module
import dataclasses
import io
import json
import re
from collections.abc import Callable, Iterator

from .markup import elements, parse


@dataclasses.dataclass
class Field:
    """An instance of a field; without a place (an attribute, a number of no text) it has a ``txt`` of its own."""

    path: str
    start: int | None
    end: int | None
    depth: int = 1
    txt: str | None = None


@dataclasses.dataclass
class Parsed:
    """A record; ``begin`` and ``end``: its place in the file."""

    text: str
    fields: list[Field] = dataclasses.field(default_factory=list)
    key: str | None = None
    doctype: str = ""
    date: str | None = None
    begin: int = 0
    end: int = 0
    deleted: bool = False


Format = Callable[..., Iterator[Parsed]]
FORMATS: dict[str, Format] = {}


def register(*names: str, binary: bool = False) -> Callable[[Format], Format]:
    """Adds a format under some names, or takes the place of what had them."""

    def add(f: Format) -> Format:
        f.binary = binary
        for name in names:
            FORMATS[name.upper()] = f
        return f

    return add


def unregister(name: str) -> None:
    FORMATS.pop(name.upper(), None)


def decoded(data: bytes) -> str:
    """UTF-8 or UTF-16 by its mark, else UTF-8 if it is that, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


# --- plain text -----------------------------------------------------------------------------------------------------------------------


def _spans(text: str, pattern: str) -> Iterator[tuple[int, int]]:
    """Places between matches of the pattern, without white space at the ends and without empty ones."""
    at = 0
    for m in [*re.finditer(pattern, text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if piece.strip():
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(piece.strip())
        at = m.end() if m else end


@register("PLAINTEXT", "PTEXT", "TEXT")
def plaintext(text: str) -> Iterator[Parsed]:
    """One record: its first line, pages (parted by form feeds), paragraphs, lines and sentences."""
    fields = [Field("firstline", s, e - 1) for s, e in [next(_spans(text, "\n"), None)] if s is not None] if text.strip() else []
    for name, pattern, depth in (("page", "\f", 1), ("paragraph", r"\n[ \t]*\n|\f", 2), ("line", r"\n|\f", 3), ("sentence", r"(?<=[.!?])\s+|\n[ \t]*\n|\f", 3)):
        fields += [Field(name, s, e - 1, depth) for s, e in _spans(text, pattern)]
    yield Parsed(text, fields, doctype="PLAINTEXT", end=len(text))


def _pieces(pattern: str, name: str, doctype: str) -> Format:
    def split(text: str) -> Iterator[Parsed]:
        for s, e in _spans(text, pattern):
            yield Parsed(text[s:e], [Field(name, 0, e - s - 1)], doctype=doctype, begin=s, end=e)

    return split


register("PARA")(_pieces(r"\n[ \t]*\n", "paragraph", "PARA"))
register("ONELINE")(_pieces("\n", "line", "ONELINE"))


@register("FIRSTLINE")
def firstline(text: str) -> Iterator[Parsed]:
    """One record whose headline is its first line."""
    first = next(_spans(text, "\n"), None)
    yield Parsed(text, [Field("headline", first[0], first[1] - 1)] if first else [], doctype="FIRSTLINE", end=len(text))


# --- names and values ----------------------------------------------------------------------------------------------------------------------


def _named(text: str, begin: int, pattern: re.Pattern, doctype: str, key: tuple[str, ...], date: tuple[str, ...] = ("date",), names: dict[str, str] | None = None) -> Parsed:
    """A record of lines that start a field where the pattern (name, value) matches, and go on with it where not."""
    fields: list[Field] = []
    at = 0
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        m = pattern.match(body)
        if m:
            name = m[1].strip()
            fields.append(Field((names or {}).get(name, name), at + m.start(2), at + len(body) - 1))
        elif fields and body.strip():
            fields[-1].end = at + len(body) - 1
        at += len(line)
    fields = [f for f in fields if f.end >= f.start]
    values = {f.path.lower(): text[f.start : f.end + 1].strip() for f in reversed(fields)}
    return Parsed(
        text, fields, next((values[k] for k in key if k in values), None), doctype, next((values[k] for k in date if k in values), None), begin, begin + len(text)
    )


_COLON = re.compile(r"([A-Za-z][\w .@-]*?)\s*:\s*(.*)")


@register("COLONDOC", "METADOC", "MEMO", "DIF", "IAFADOC", "ROADS++")
def colondoc(text: str) -> Iterator[Parsed]:
    """``name: value`` lines, one record; other lines go on with the value before them."""
    yield _named(text, 0, _COLON, "COLONDOC", ("key", "id", "entry_id", "handle"))


@register("COLONGRP", "BIBCOLON")
def colongrp(text: str) -> Iterator[Parsed]:
    """``name: value`` lines in records parted by empty lines."""
    for s, e in _spans(text, r"\n[ \t]*\n"):
        yield _named(text[s:e], s, _COLON, "COLONGRP", ("key", "id", "handle"))


def _tagged(doctype: str, first: str, line: str, key: tuple[str, ...], date: tuple[str, ...], names: dict[str, str]) -> Format:
    """Files of tagged lines; a record starts where ``first`` matches at a line's start."""
    start, pattern = re.compile(first, re.M), re.compile(line)

    def split(text: str) -> Iterator[Parsed]:
        begins = [m.start() for m in start.finditer(text)]
        if not begins:
            return
        for s, e in zip(begins, [*begins[1:], len(text)], strict=True):
            body = text[s:e].rstrip()
            yield _named(body, s, pattern, doctype, key, date, names)

    return split


register("RIS")(
    _tagged("RIS", r"^TY  - ", r"([A-Z][A-Z0-9])  - ?(.*)", ("id",), ("py", "y1", "da"), {"TI": "title", "T1": "title", "AU": "author", "A1": "author", "AB": "abstract", "KW": "keyword", "ID": "id", "PY": "py"})
)
register("MEDLINE")(_tagged("MEDLINE", r"^PMID- ", r"([A-Z]{2,4})\s*- ?(.*)", ("pmid", "ui"), ("dp", "da"), {"TI": "title", "AU": "author", "AB": "abstract", "MH": "subject"}))
register("REFERBIB", "ENDNOTE", "PAPYRUS")(
    _tagged("REFERBIB", r"(?:\A|(?<=\n\n))%[A-Z0-9] ", r"%([A-Z0-9!@]) (.*)", ("f", "m"), ("date",), {"T": "title", "A": "author", "D": "date", "X": "abstract", "K": "keyword", "J": "journal"})
)
register("DIALOG-B")(_tagged("DIALOG-B", r"^AN- ", r"([A-Z]{2})- ?(.*)", ("an",), ("py",), {"TI": "title", "AU": "author", "AB": "abstract"}))


@register("BIBTEX")
def bibtex(text: str) -> Iterator[Parsed]:
    """``@type{key, name = value, ..}`` entries; values in braces (which nest), quotes or bare."""
    at = 0
    while (m := re.compile(r"@(\w+)\s*\{\s*([^,\s}]*)\s*,?").search(text, at)) is not None:
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        at = end
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        body, base = text[m.start() : end], m.start()
        fields = [Field("type", m.start(1) - base, m.end(1) - base - 1)]
        place = m.end() - base
        while (f := re.compile(r"([A-Za-z][\w-]*)\s*=\s*").search(body, place)) is not None:
            s = f.end()
            if body[s : s + 1] == "{":
                level, e = 1, s + 1
                while e < len(body) and level:
                    level += {"{": 1, "}": -1}.get(body[e], 0)
                    e += 1
                s, place, e = s + 1, e, e - 1
            elif body[s : s + 1] == '"':
                e = body.find('"', s + 1)
                e = len(body) if e < 0 else e
                s, place = s + 1, e + 1
            else:
                e = s + len(re.match(r"[^,}\s]*", body[s:])[0])
                place = e + 1
            if e > s:
                fields.append(Field(f[1].lower(), s, e - 1))
        values = {f.path: body[f.start : f.end + 1] for f in fields}
        yield Parsed(body, fields, m[2] or None, "BIBTEX", values.get("year"), base, end)


@register("SOIF", "HARVEST")
def soif(text: str) -> Iterator[Parsed]:
    """``@TEMPLATE { url`` and ``name{size}:`` with values of so many bytes, up to ``}``."""
    for m in re.finditer(r"@(\w+)\s*\{\s*(\S+)\n", text):
        at, fields = m.end(), []
        while (f := re.compile(r"([\w-]+)\{(\d+)\}:[ \t]?").match(text, at)) is not None:
            # the size counts bytes
            value = text[f.end() :].encode()[: int(f[2])].decode("utf-8", "ignore")
            if value:
                fields.append(Field(f[1].lower(), f.end() - m.start(), f.end() - m.start() + len(value) - 1))
            at = f.end() + len(value)
            at += len(re.match(r"[ \t]*\n?", text[at:])[0])
        yield Parsed(text[m.start() : at].rstrip(), fields, m[2], "SOIF", None, m.start(), at)


# --- mail --------------------------------------------------------------------------------------------------------------------------------------


def _message(text: str, begin: int, doctype: str) -> Parsed:
    """Headers as fields by name, and the body."""
    head = re.search(r"\n[ \t]*\r?\n", text)
    cut = head.start() if head else len(text)
    skip = len(re.match(r"(?:From .*\n)?", text)[0])
    parsed = _named(text[skip:cut], begin, re.compile(r"([!-9;-~]+):[ \t]*(.*)"), doctype, ("message-id",))
    fields = [Field(f.path.lower(), f.start + skip, f.end + skip, 1) for f in parsed.fields]
    if head and text[head.end() :].strip():
        fields.append(Field("body", head.end(), len(text.rstrip()) - 1, 1))
    date = parsed.date
    if date:
        from email.utils import parsedate_to_datetime

        try:
            date = parsedate_to_datetime(date).strftime("%Y-%m-%d")
        except (ValueError, TypeError):
            pass
    return Parsed(text.rstrip(), fields, parsed.key, doctype, date, begin, begin + len(text))


@register("MAILFOLDER", "NEWSFOLDER")
def mailfolder(text: str) -> Iterator[Parsed]:
    """Messages that each start with a ``From`` line after an empty line."""
    begins = [m.start() for m in re.finditer(r"(?:\A|(?<=\n\n))From \S+.*\n", text)] or [0]
    for s, e in zip(begins, [*begins[1:], len(text)], strict=True):
        if text[s:e].strip():
            yield _message(text[s:e], s, "MAILFOLDER")


@register("MAILDIGEST", "LISTDIGEST", "IRLIST")
def maildigest(text: str) -> Iterator[Parsed]:
    """Messages of a digest, parted by lines of dashes; what stands before the first such line is the preamble."""
    pieces = list(_spans(text, r"(?m)^-{20,}[ \t]*$"))
    for s, e in pieces:
        piece = text[s:e]
        if re.match(r"[!-9;-~]+:", piece):
            yield _message(piece, s, "MAILDIGEST")


# --- JSON --------------------------------------------------------------------------------------------------------------------------------------


def flatten_json(source: object, arrays: bool = True, path: str = "") -> Iterator[tuple[str, str]]:
    """``(path, value)`` of an object's leaves: ``a|b``, and ``a|0`` for elements, or ``a`` again and again where not ``arrays``."""
    if isinstance(source, str) and not path:
        try:
            source = json.loads(source)
        except ValueError:
            return
    if isinstance(source, dict):
        for k, v in source.items():
            yield from flatten_json(v, arrays, f"{path}|{k}" if path else str(k)) if isinstance(v, (dict, list)) else _leaf(f"{path}|{k}" if path else str(k), v)
    elif isinstance(source, list):
        for n, v in enumerate(source):
            own = (f"{path}|{n}" if path else str(n)) if arrays else path
            yield from flatten_json(v, arrays, own) if isinstance(v, (dict, list)) else _leaf(own, v)


def _leaf(path: str, value: object) -> Iterator[tuple[str, str]]:
    if value is not None:
        yield path, json.dumps(value) if isinstance(value, bool) else value if isinstance(value, str) else format(value, "") if isinstance(value, int) else repr(value)


def _objects(text: str) -> Iterator[tuple[int, int, object]]:
    """JSON values that follow each other, with comments between them left out; an array at the top holds them too."""
    decoder, at = json.JSONDecoder(), 0
    gap = re.compile(r"(?:[\s,]+|//[^\n]*|#[^\n]*|/\*.*?\*/)*", re.S)
    at = gap.match(text, at).end()
    inside = text[at : at + 1] == "["
    at += inside
    while True:
        at = gap.match(text, at).end()
        if at >= len(text) or text[at] == "]":
            return
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            found = text.find("{", at + 1)
            if found < 0:
                return
            at = found
            continue
        yield at, end, value
        at = end


_WRAPPERS = {"$oid", "$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$symbol", "$uuid"}


def _unwrapped(value: object) -> object:
    """Extended JSON: single-name wrappers give way to what they hold."""
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value)) in _WRAPPERS:
            return _unwrapped(next(iter(value.values())))
        return {k: _unwrapped(v) for k, v in value.items()}
    return [_unwrapped(v) for v in value] if isinstance(value, list) else value


def _record_of(value: object, begin: int, end: int, doctype: str, arrays: bool, key: str | None = None) -> Parsed:
    """The leaves as lines of text, each of which is its field's extent."""
    lines, fields, at = [], [], 0
    for path, leaf in flatten_json(value, arrays):
        fields.append(Field(path, at, at + len(leaf) - 1, path.count("|") + 1) if leaf else Field(path, None, None, path.count("|") + 1, ""))
        lines.append(leaf)
        at += len(leaf) + 1
    values = {f.path.lower(): line for f, line in zip(fields, lines, strict=True)}
    found = key or next((values[k] for k in ("_id", "@id", "id", "key") if k in values), None)
    return Parsed("\n".join(lines), fields, found, doctype, next((values[k] for k in ("date", "datepublished", "timestamp", "created_at") if k in values), None), begin, end)


@register("JSON", "NDJSON", "JSONL")
def json_format(text: str, arrays: bool = True) -> Iterator[Parsed]:
    """Objects that follow each other, on lines of their own or not, or in one array."""
    for s, e, value in _objects(text):
        if isinstance(value, dict):
            yield _record_of(value, s, e, "JSON", arrays)


@register("EJSON")
def ejson(text: str, arrays: bool = True) -> Iterator[Parsed]:
    for s, e, value in _objects(text):
        if isinstance(value, dict):
            yield _record_of(_unwrapped(value), s, e, "EJSON", arrays)


@register("JSON-LD", "JSONLD")
def jsonld(text: str, arrays: bool = True) -> Iterator[Parsed]:
    """Linked data: each node of a graph is a record; the context is none."""
    for s, e, value in _objects(text):
        if isinstance(value, dict):
            for node in value["@graph"] if isinstance(value.get("@graph"), list) else [value]:
                if isinstance(node, dict):
                    yield _record_of({k: v for k, v in node.items() if k != "@context"}, s, e, "JSON-LD", arrays)


_ACTIONS = ("index", "create", "update", "delete")


@register("ESBULK", "ES-NDJSON")
def esbulk(text: str, arrays: bool = True) -> Iterator[Parsed]:
    """Bulk files: an action line and, unless it deletes, a body line; ``_id`` is the key."""
    waiting = None
    for s, e, value in _objects(text):
        if not isinstance(value, dict):
            continue
        action = next(iter(value), None)
        if waiting is None and len(value) == 1 and action in _ACTIONS and isinstance(value[action], dict):
            if action == "delete":
                yield Parsed("", [], str(value[action].get("_id")), "ESBULK", None, s, e, True)
            else:
                waiting = value[action].get("_id")
                waiting = "" if waiting is None else str(waiting)
        else:
            body = value.get("doc", value) if waiting is not None and isinstance(value.get("doc"), dict) else value
            yield _record_of(body, s, e, "ESBULK", arrays, waiting or None)
            waiting = None


@register("CIRRUS")
def cirrus(text: str) -> Iterator[Parsed]:
    """Bulk files whose arrays are repeated fields."""
    for doc in esbulk(text, arrays=False):
        doc.doctype = "CIRRUS"
        yield doc


# --- markup ------------------------------------------------------------------------------------------------------------------------------------


def _of_markup(source: str, is_html: bool, doctype: str, begin: int = 0) -> Parsed:
    text, found = parse(source, is_html)
    fields = [Field(p, s, e, d, v) for p, s, e, d, v in found if s is None or e >= s]
    values = {f.path.lower().rpartition("/")[2]: f.txt for f in reversed(fields) if f.txt}
    key = next((values[k] for k in ("guid", "id", "identifier", "key") if k in values), None)
    return Parsed(text.rstrip("\n"), fields, key, doctype, next((values[k] for k in ("date", "pubdate", "updated", "published") if k in values), None), begin, begin + len(source))


@register("XML", "SGML", "SGMLNORM", "SGMLTAG", "XMLBASE", "RDF", "CAP", "NEWSML", "GILSXML", "ISO19115")
def xml(text: str, row_tag: str | None = None) -> Iterator[Parsed]:
    """One record, or one for each element ``row_tag``."""
    if row_tag is None:
        yield _of_markup(text, False, "XML")
    else:
        for s, e in elements(text, row_tag):
            yield _of_markup(text[s:e], False, "XML", s)


@register("RSS", "RSS2", "ATOM")
def feed(text: str) -> Iterator[Parsed]:
    """The items or entries of a feed."""
    for tag in ("item", "entry"):
        for s, e in elements(text, tag):
            yield _of_markup(text[s:e], False, "RSS" if tag == "item" else "ATOM", s)


@register("HTML", "HTML--", "HTMLZERO")
def html_format(text: str) -> Iterator[Parsed]:
    yield _of_markup(text, True, "HTML")


@register("HTMLHEAD", "HTMLMETA")
def htmlmeta(text: str) -> Iterator[Parsed]:
    """The head alone: its elements, and the names of ``meta`` with their contents."""
    head = re.search(r"<head\b.*?(?:</head>|<body\b|\Z)", text, re.S | re.I)
    doc = _of_markup(head[0] if head else "", True, "HTMLMETA")
    for m in re.finditer(r"""<meta\s+[^>]*?(?:name|property)\s*=\s*["']?([^"'\s>]+)["']?[^>]*?content\s*=\s*(?:"([^"]*)"|'([^']*)')""", head[0] if head else "", re.I):
        doc.fields.append(Field(m[1].lower(), None, None, 1, m[2] if m[2] is not None else m[3]))
    yield doc


# --- tables ------------------------------------------------------------------------------------------------------------------------------------


@register("CSV", "TSV", "TSLDOC", "TAB")
def csv_format(text: str, names: list[str] | None = None, sep: str | None = None) -> Iterator[Parsed]:
    """A record for each row; cells beyond the header's are ``FIELDnn``."""
    first = text.split("\n", 1)[0]
    sep = sep or max(",;\t|\x1f", key=first.count)
    rows = csv_module.reader(io.StringIO(text), delimiter=sep)
    head = names
    for n, row in enumerate(rows):
        if head is None:
            head = row
            continue
        lines, fields, at = [], [], 0
        for k, cell in enumerate(row):
            if cell:
                fields.append(Field(head[k] if k < len(head) else f"FIELD{k + 1:02d}", at, at + len(cell) - 1))
                lines.append(cell)
                at += len(cell) + 1
        if fields:
            values = {f.path.lower(): line for f, line in zip(fields, lines, strict=True)}
            yield Parsed("\n".join(lines), fields, values.get("key") or values.get("id"), "CSV", values.get("date"), n, n)


# --- binary ------------------------------------------------------------------------------------------------------------------------------------


@register("MARC", "USMARC", binary=True)
def marc(data: bytes) -> Iterator[Parsed]:
    """ISO 2709: a leader, a directory, and fields with subfields ``245$a``."""
    at = 0
    while at + 24 < len(data):
        leader = data[at : at + 24]
        if not leader[:5].isdigit() or not leader[12:17].isdigit() or int(leader[:5]) < 25:
            return
        record = data[at : at + int(leader[:5])]
        base, place, fields, lines, size = int(leader[12:17]), 24, [], [], 0
        key = None
        while place + 12 <= base and record[place : place + 1] != b"\x1e":
            tag, length, start = record[place : place + 3].decode("latin-1"), record[place + 3 : place + 7], record[place + 7 : place + 12]
            place += 12
            if not (length.isdigit() and start.isdigit()):
                continue
            body = decoded(record[base + int(start) : base + int(start) + int(length)]).rstrip("\x1e")
            parts = body.split("\x1f")
            pairs = [(tag, parts[0])] if len(parts) == 1 else [(f"{tag}${p[0]}", p[1:]) for p in parts[1:] if p]
            for name, value in pairs:
                if value:
                    fields.append(Field(name, size, size + len(value) - 1))
                    lines.append(value)
                    size += len(value) + 1
                    key = value.strip() if name == "001" else key
        yield Parsed("\n".join(lines), fields, key, "MARC", None, at, at + len(record))
        at += len(record)


@register("IMAGE", "GIF", "PNG", "JPEG", "TIFF", binary=True)
def image(data: bytes) -> Iterator[Parsed]:
    """An image's kind and size."""
    kind, width, height = "unknown", None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        kind, width, height = "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        kind, width, height = "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    elif data[:2] == b"\xff\xd8":
        kind, at = "jpeg", 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
                break
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    elif data[:4] in (b"II*\0", b"MM\0*"):
        kind = "tiff"
    fields = [Field(n, None, None, 1, str(v)) for n, v in (("kind", kind), ("width", width), ("height", height), ("bytes", len(data))) if v is not None]
    yield Parsed("", fields, None, "IMAGE", None, 0, len(data))


@register("BINARY", "XBINARY", "PS", "PDF", "RESOURCE", binary=True)
def binary(data: bytes, least: int = 4) -> Iterator[Parsed]:
    """Runs of printable ASCII, as the ``strings`` of a file."""
    lines = [m.decode("ascii") for m in re.findall(rb"[\x20-\x7e\t]{%d,}" % least, data)]
    text, fields, at = "\n".join(lines), [], 0
    for line in lines:
        fields.append(Field("string", at, at + len(line) - 1))
        at += len(line) + 1
    yield Parsed(text, fields, None, "BINARY", None, 0, len(data))


def filtered(command: list[str], then: str = "PLAINTEXT", timeout: float = 60.0) -> Format:
    """A format that pipes the file through a program and reads what comes out by another format.  Off unless registered."""

    def run(data: bytes) -> Iterator[Parsed]:
        import subprocess

        done = subprocess.run(command, input=data, capture_output=True, timeout=timeout, check=True)
        make = FORMATS[then.upper()]
        yield from make(done.stdout if getattr(make, "binary", False) else decoded(done.stdout))

    run.binary = True
    return run


# --- what is it? ---------------------------------------------------------------------------------------------------------------------------------


def detect(data: bytes) -> str:
    """The format's name by the file's beginning."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" or data[:6] in (b"GIF87a", b"GIF89a") or data[:2] == b"\xff\xd8" or data[:4] in (b"II*\0", b"MM\0*"):
        return "IMAGE"
    if data[:5] in (b"%PDF-", b"%!PS-") or b"\0" in data[:1024] and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return "BINARY"
    if re.match(rb"[0-9]{5}[a-z][a-z]", data[:8]) and re.match(rb"[0-9]{5}", data[12:17]):
        return "MARC"
    head = decoded(data[:4096]).lstrip("﻿ \t\r\n")
    low = head[:1024].lower()
    if re.match(r'\{\s*"(index|create|update|delete)"\s*:\s*\{', head):
        return "ESBULK"
    if head[:1] in "{[" and re.match(r'[\[{]\s*(["{\]}]|//|$)', head):
        return "JSON-LD" if '"@context"' in head else "EJSON" if re.search(r'"\$(oid|date|numberLong)"', head) else "JSON"
    if low.startswith(("<!doctype html", "<html")) or re.match(r"(<\?xml[^>]*>\s*)?(<!doctype[^>]*>\s*)?<html", low):
        return "HTML"
    if head.startswith("<"):
        return "RSS" if re.search(r"<rss\b|<rdf:RDF\b", head) and "<item" in head else "ATOM" if "<feed" in low and "<entry" in head else "XML"
    if re.match(r"From \S+ .*\d", head):
        return "MAILFOLDER"
    if re.match(r"TY  - ", head):
        return "RIS"
    if re.match(r"PMID- ", head):
        return "MEDLINE"
    if re.match(r"%[A-Z0-9] ", head):
        return "REFERBIB"
    if re.match(r"@\w+\s*\{\s*\S+\n[\w-]+\{\d+\}:", head):
        return "SOIF"
    if re.match(r"@\w+\s*\{", head):
        return "BIBTEX"
    lines = head.splitlines()[:20]
    if len(lines) > 1 and re.search(r"^-{20,}\s*$", head, re.M) and re.search(r"^(From|Subject|Date): ", head, re.M):
        return "MAILDIGEST"
    if len(lines) > 1:
        for sep in "\t,;|\x1f":
            cells = [len(row) for row in csv_module.reader(io.StringIO("\n".join(lines)), delimiter=sep)]
            if len(cells) > 1 and cells[0] == cells[1] > 1 and len(lines[0]) < 1000:
                return "CSV"
    if lines and all(_COLON.match(x) or x[:1] in " \t" or not x.strip() for x in lines):
        return "COLONGRP" if re.search(r"\n[ \t]*\n\S", head) else "COLONDOC"
    return "PLAINTEXT"


@register("AUTODETECT", "JSONDETECT", binary=True)
def autodetect(data: bytes) -> Iterator[Parsed]:
    make = FORMATS[detect(data)]
    yield from make(data if make.binary else decoded(data))
