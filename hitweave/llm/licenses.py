"""License scans by template-markup matching.

A template is a license's wording with markup: ``<<optional>> .. <<end>>`` may be
absent, ``<<var:MIN-MAX:REGEX>>`` stands for MIN to MAX words of which each
matches REGEX (any word without one).  Everything else is mandatory and must
occur word by word.  A template is compiled into an automaton over words, which
accepts a text if some run of its words goes through from the first state to
the last; the automata of all templates are run side by side.

Most templates are a license's opening clause or notice, not its whole wording: a
label says that this wording is there, not that nothing else follows.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import WORD_BYTES, extended, free

#: Phrases that give a label wherever their words stand consecutively.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<optional>>\"<<end>>Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var:0-1:1>> "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var:0-1:2>> Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Fixed values: (label, template), the licenses' own wordings.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", _PERMISSION),
    ("mit", "<<optional>>This <<var:1-3:>> is<<end>> released under the <<optional>>terms of the<<end>> MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", _REDISTRIBUTION),
    ("bsd-3-clause", _REDISTRIBUTION + " <<var:0-1:3>> Neither the name of <<var:1-12:>> nor the names of its contributors may be used to endorse or promote products"),
    ("isc", "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU <<optional>>Lesser<<end>> General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-<<var:1-1:[123]>>.0-<<var:1-3:only|or|later>>"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v<<optional>>ersion<<end>> 2.0"),
    ("cc-by-nc", "Licensed under <<optional>>a<<end>> CC BY-NC <<var:0-2:[0-9]>>"),
    ("cc-by-sa", "Licensed under <<optional>>a<<end>> CC BY-SA <<var:0-2:[0-9]>>"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var:0-2:[0-9]>> <<optional>>International<<end>> License"),
    ("cc-by", "Creative Commons Attribution <<var:0-2:[0-9]>> <<optional>>International<<end>> License"),
    ("cc0", "CC0 <<var:0-2:[0-9]>> <<optional>>Universal<<end>>"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclasses.dataclass
class Automaton:
    """States 0 to len(steps); ``steps[i]`` leads from i to i + 1 by a word, ``jumps`` (from, to) by none."""

    label: str
    steps: list[bytes | re.Pattern | None]
    jumps: list[tuple[int, int]]
    mandatory: int

    def __post_init__(self):
        after: dict[int, set[int]] = {}
        for state in range(len(self.steps), -1, -1):  # jumps lead forward
            after[state] = {state}.union(*(after[b] for a, b in self.jumps if a == state))
        self.after = after
        self.start = after[0]
        firsts = [self.steps[s] for s in self.start if s < len(self.steps)]
        if len(self.steps) in self.start or not all(isinstance(x, bytes) for x in firsts):
            raise ValueError(f"a template starts with a mandatory word or an optional region that does: {self.label}")
        self.firsts = frozenset(firsts)
        self.needed = max((x for n, x in enumerate(self.steps) if isinstance(x, bytes) and not self._optional(n)), key=len)

    def _optional(self, step):
        return any(a <= step < b for a, b in self.jumps)

    def end(self, text: Sequence[bytes], at: int) -> int | None:
        """Where the longest run of words from ``at`` that is accepted ends, or None."""
        states, best = self.start, None
        while states:
            if len(self.steps) in states:
                best = at
            if at >= len(text):
                break
            word, reached = text[at], set()
            for s in states:
                if s < len(self.steps):
                    x = self.steps[s]
                    if x is None or (x == word if isinstance(x, bytes) else x.fullmatch(word)):
                        reached |= self.after[s + 1]
            states, at = reached, at + 1
        return best

    def regex(self) -> str:
        """The same as a regular expression over words that are each followed by a space."""
        out, opens, shuts = [], [a for a, _ in self.jumps], [b for _, b in self.jumps]
        for n in range(len(self.steps) + 1):
            out.append(")?" * shuts.count(n))
            out.append("(?:" * opens.count(n))
            if n < len(self.steps):
                x = self.steps[n]
                out.append("[^ ]+ " if x is None else f"{x.decode()} " if isinstance(x, bytes) else f"(?:{x.pattern.decode()}) ")
        return "".join(out)


def compile_template(label: str, template: str) -> Automaton:
    steps: list[bytes | re.Pattern | None] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    for piece in re.split(r"(<<.*?>>)", template):
        if piece == "<<optional>>":
            opened.append(len(steps))
        elif piece == "<<end>>":
            jumps.append((opened.pop(), len(steps)))
        elif piece.startswith("<<var:"):
            low, high, pattern = re.fullmatch(r"<<var:(\d+)-(\d+):(.*)>>", piece).groups()
            one = re.compile(pattern.encode()) if pattern else None
            steps += [one] * int(low)
            first = len(steps)
            steps += [one] * (int(high) - int(low))
            jumps += [(n, len(steps)) for n in range(first, len(steps))]  # as many as there are, up to the most
        elif piece.startswith("<<"):
            raise ValueError(f"no such markup: {piece}")
        else:
            steps += words(piece)
    if opened:
        raise ValueError(f"an optional region does not end: {template}")
    return Automaton(label, steps, [j for j in jumps if j[0] < j[1]], sum(isinstance(x, bytes) for x in steps))


def _scanned(batches, phrases, templates):
    import pyarrow as pa

    automata = [compile_template(*t) for t in templates]
    places = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        out = [[] for _ in range(8)]
        for n in range(batch.num_rows):
            tokens = (texts[n].as_py() or b"").translate(WORD_BYTES).split()
            line = b" " + b" ".join(tokens) + b" "
            base, starts = set(), []
            for phrase, label in places:
                at = line.find(phrase)
                if at >= 0:
                    base.add(label)
                word, last = 0, 0
                while at >= 0:
                    word, last = word + line.count(b" ", last, at), at
                    starts.append(word)
                    at = line.find(phrase, at + 1)
            found = []
            live = [a for a in automata if a.needed in line]
            if live:
                by: dict[bytes, list[Automaton]] = {}
                for a in live:
                    for w in a.firsts:
                        by.setdefault(w, []).append(a)
                for at, w in enumerate(tokens):
                    for a in by.get(w, ()):
                        end = a.end(tokens, at)
                        if end is not None:
                            found.append((a.label, at, end, a.mandatory))
            labels = base | {x[0] for x in found}
            most = max((x[3] for x in found), default=0)
            score = (0.5 + 0.5 * (1 - 0.5 ** (most / 4))) if labels else 0.0
            row = (
                len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [{"label": x[0], "first": x[1], "end": x[2]} for x in found],
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
            [*batch.schema.names[1:], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
        )


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    carry: Iterable[str] = ("doc_id",),
    suffix: str = "",
) -> DataFrame:
    """``(*carry, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)`` for every row of ``docs``.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word``
    are their smallest and largest start (null without any).  ``matches``: the
    runs of words that a template's automaton accepts.  ``score``: 0 without a
    label, 0.5 for phrases alone, and from there towards 1 the more mandatory
    words the longest accepted template has.  A null text is an empty one; rows
    repeated in ``docs`` each give a row.  Nothing is shuffled.  ``suffix`` ends the
    names of the eight columns, which give way to carried ones of their names by
    underscores.
    """
    carry = list(carry)
    out = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = extended(
        out, 1, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label:string,first:long,end:long>>",
    )
    got = out.mapInArrow(lambda b: _scanned(b, phrases, templates), schema)
    own = got.columns[len(carry) :]
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(n) for c, n in zip(own, free(own, carry, suffix), strict=True)])
