"""License scans against regular expressions and a word-by-word count."""

import re

import pytest

from hitweave.llm import licenses
from hitweave.llm.queries import op4_license_templates


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += found
        base |= {label} if found else set()
    line = " " + "".join(x + " " for x in w)
    more = {a.label for a in (licenses.compile_template(*t) for t in licenses.TEMPLATES) if re.search(f"(?<= ){a.regex()}", line)}
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


TEXTS = [
    None, "", "...", "The MIT License", "mit license mit license", "This file is released under the MIT License.", "CC-BY 4.0, cc by", "Licensed under CC BY-NC 4.0 here",
    "GNU General Public License", "licensed under the terms of the GNU General Public License, version 3", "licensed under GNU General Public License version 2",
    "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: Apache-2.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation", "Permission is hereby granted, free of charge", "Creative Commons Attribution 4.0 International License", "cc0 1.0 universal",
    "word " * 50_000 + "apache license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
]


def test_against_regular_expressions(spark):
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for n, t in enumerate(TEXTS):
        r = got[n]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, carry=["labels", "doc_id"]).columns[:2] == ["labels", "doc_id"]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op4_license_templates(spark, sf_dir).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(d.text)


def test_mandatory_wording_must_match():
    a = licenses.compile_template("x", "start <<optional>>maybe this<<end>> then <<var:1-2:[0-9]+>> end")
    run = lambda t: a.end(t.encode().split(), 0)
    assert run("start then 1 end") == 4 and run("start maybe this then 1 22 end") == 7
    assert run("start maybe then 1 end") is None and run("start then end") is None and run("start then 1 2 3 end") is None and run("start then x end") is None


def test_markup_errors():
    for bad in ("a <<optional>> b", "<<var:1-2:>> first", "a <<nothing>> b"):
        with pytest.raises((ValueError, AttributeError)):
            licenses.compile_template("x", bad)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "MIT License", "own", 5)], "doc_id long, text string, labels string, score int")
    row = licenses.scan(df, carry=["labels", "score"]).collect()[0]
    assert (row["labels"], row["score"], row["labels_"]) == ("own", 5, "mit") and licenses.scan(df, suffix="_l").columns[1] == "n_words_l"
