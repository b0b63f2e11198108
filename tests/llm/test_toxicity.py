"""Toxicity: the noisy-or in plain Python, held-out accuracy, and what must not matter."""

import math
import zlib

import pytest

from hitweave.llm import toxicity
from hitweave.llm.queries import op2_toxicity_noisy_or

BIG = "/root/testdata/sf0.1"


def brute(text, model):
    """1 - prod(1 - p) over the sentences that have words."""
    keep, out, sentence = 1.0, [], []
    for c in (text or "").encode() + b"\n":
        if c in b".!?\n\r":
            out.append(bytes(sentence).split())
            sentence = []
        else:
            sentence.append(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32)
    for words in out:
        if words:
            z, told = model.bias, False
            for w in words:
                marked = b"^" + w + b"$"
                parts = {marked} | {marked[i:j] for i in range(len(marked)) for j in range(i + 3, min(i + 6, len(marked)) + 1)}
                told = told or any(p in model.weights for p in parts)
                z += sum(model.weights.get(p, 0.0) for p in parts)
            if not told:
                continue
            p = 1 / (1 + math.exp(-max(-700, min(700, z))))
            keep *= 1 - p if p >= 0.05 else 1
    return 1 - keep


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))


def test_scores_against_plain_noisy_or(spark, sf_dir, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op2_toxicity_noisy_or(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert abs(got[i].score - brute(t, model)) < 1e-9
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in op2_toxicity_noisy_or(spark, BIG).where("held_out").collect() if labels.get(r.doc_id) is not None]
    toxic, clean = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert toxic and clean
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.9, above
    assert sum(s >= 0.5 for s in toxic) >= 0.8 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.01 * len(clean)


def test_length_does_not_decide(spark):
    """Very long clean texts, of whole clean documents one after the other, stay clean; a toxic one among them is found."""
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 5"
    model = toxicity.train(docs, labels.where(f"{fold} <> 0"))
    known = docs.join(labels, "doc_id").where(f"{fold} = 0").select("text", "toxic").collect()
    clean, toxic = [r.text for r in known if r.toxic == 0 and r.text], [r.text for r in known if r.toxic == 1 and r.text]
    single = toxicity.scored(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), model).collect()
    quiet = [clean[r.doc_id] for r in single if r.score < 0.05]
    assert len(quiet) > 0.98 * len(clean)
    long = [" . ".join(quiet[n::8]) for n in range(8)]
    rows = [(n, t) for n, t in enumerate(long)] + [(100 + n, " . ".join(quiet[:20] + [t] + quiet[20:40])) for n, t in enumerate(toxic[:40])]
    rows.append((99, (quiet[0] + " . ") * (1_000_000 // len(quiet[0]))))
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[99] < 0.05 and all(got[n] < 0.05 for n in range(8))
    assert sum(v >= 0.5 for k, v in got.items() if k >= 100) >= 0.8 * min(40, len(toxic))


def test_sample_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(n, f"word{n} foul scum. " * (50 if n % 2 else 5)) for n in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, share: seen.append(list(bags)))
    toxicity.train(df, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    toxicity.train(df, labels)
    assert len(seen[0]) == 40 and 20 < len(seen[1]) < 40
    assert all(sum(len(b" ".join(w)) for w, y in seen[1] if y == label) <= 3000 for label in (0, 1))


def test_held_out_labels_and_other_columns_do_not_matter(spark, sf_dir, model):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = toxicity.train(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source"), labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert model.weights == other.weights and model.bias == other.bias


def test_finds_the_offending_sentence(spark):
    clean = ["The garden is green. Rain fell at night.", "We walk to the river. It is cold.", "Bread and butter. Tea at five."] * 10
    toxic = ["The garden is green. You foul grubwort scum. Rain fell.", "Bread and butter. A grubwort scum lives here.", "We walk. Foul grubwort! It is cold."] * 10
    bags = [(toxicity._words(t.encode()), y) for y, ts in ((0, clean), (1, toxic)) for t in ts]
    m = toxicity.fit(bags)
    df = spark.createDataFrame([(1, "Tea at night. Foul grubwort scum walks. The river is cold."), (2, "Tea at night. The river is cold.")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(df, m).collect()}
    assert got[1].score > 0.5 > got[2].score and not got[2].offending
    assert ["Tea at night. Foul grubwort scum walks. The river is cold."[x.start : x.end].strip() for x in got[1].offending] == ["Foul grubwort scum walks"]


def test_one_class_only():
    assert toxicity.fit([]).bias < -700 and toxicity.fit([([b"a", b"b"], 0)]).bias < -700 and toxicity.fit([([b"a", b"b"], 1)]).weights == {}


def test_edges(spark, model):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, " .!? ", 0.5), (4, "word " * 200_000, 0.5), (4, "word " * 200_000, 0.5), (None, "a b", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.scored(df, model, carry=["doc_id", "score"], suffix="_t").collect()
    assert len(got) == 6 and all(0 <= r.score_t <= 1 and r.score == 0.5 for r in got)
    assert [r.score_t for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert toxicity.scored(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(2, 1), (4, 0), (4, 1), (None, 1), (9, None), (1, 7)], "doc_id long, toxic int")
    assert toxicity.train(df, labels).bias is not None and toxicity.train(df.limit(0), labels.limit(0)).bias < -700
