"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Only documents carry labels.  A sentence's probability is a logistic function of
its words' weights; a document is toxic if any sentence is, which the noisy-or
``1 - prod(1 - p)`` puts in a smooth form.  The weights maximise the likelihood
of the documents' labels, so the sentences are never labelled, yet the trained
model tells which of them offend.

A word weighs what its character n-grams (with its ends marked) weigh, so that
forms that were never seen are known by their stems.  Only n-grams with which
label 1 is significantly more frequent have a weight, by the likelihood ratio of
their document counts.  A sentence in which nothing has a weight has the probability
zero, and in scoring so has one below ``LEAST``: weak hints don't add up, however
many there are, so that a text's length alone decides nothing.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._base import extended, free, written

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Bytes of their words at most, of each class: the first by hashed id that fit.  So much comes to the driver.
SAMPLE_BYTES = 16 << 20
#: Lengths of the n-grams, beside whole words; the likelihood ratio that they have at least.
LENGTHS, RATIO = (3, 4, 5, 6), 20.0
#: Buckets of the first count of n-grams.
BUCKETS = 1 << 21
#: Probability below which a sentence adds nothing to a document's score.
LEAST = 0.05
#: Steps of the fit and their size, and the penalty.
STEPS, STEP, PENALTY = 150, 0.1, 1e-5
#: Bytes of text that are scored at a time; words whose weight a task remembers.
CHUNK, REMEMBERED = 1 << 20, 100_000

_BREAK = b"\x01"
#: Words stay (A-Z lower-cased), sentence ends become a mark, all else a space.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 1 if c in b".!?\n\r" else 32
    for c in range(256)
)


def _words(text: bytes) -> list[bytes]:
    """The words, and a mark at each sentence's end."""
    return text.translate(_BYTES).replace(_BREAK, b" \x01 ").split()


def grams(word: bytes, lengths: Sequence[int] = LENGTHS) -> set[bytes]:
    """The word between marks of its ends, and the n-grams (of bytes) of that."""
    s = b"^" + word + b"$"
    return {s, *(s[at : at + n] for n in lengths for at in range(len(s) - n + 1))}


@dataclasses.dataclass
class Model:
    """weights: of n-grams; bias: of every sentence."""

    weights: dict[bytes, float]
    bias: float
    lengths: tuple[int, ...] = LENGTHS

    def word(self, word: bytes) -> float:
        get = self.weights.get
        return sum(sorted(w for g in grams(word, self.lengths) if (w := get(g)) is not None))

    def sentences(self, values):
        """For words' weights, with nan at each sentence's end: the sentences' log-odds.  Those without a word that has a weight are at -inf."""
        import numpy as np

        end = np.isnan(values)
        ends = np.flatnonzero(end)
        sums = np.concatenate([[0.0], np.cumsum(np.where(end, 0.0, values))])
        counts = np.concatenate([[0], np.cumsum(~end & (values != 0))])
        starts = np.concatenate([[0], ends[:-1] + 1])
        return np.where(counts[ends] > counts[starts], sums[ends] - sums[starts] + self.bias, -np.inf)


class _Weights(dict):
    """Words' weights as they come; forgets all when it grows large."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self[_BREAK] = float("nan")

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
            self[_BREAK] = float("nan")
        got = self[word] = self.model.word(word)
        return got


def _ratio(ones, zeros, all_ones, all_zeros):
    """The likelihood ratio of counts in the documents of both labels, 0 where label 1 isn't the more frequent."""
    import numpy as np

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    both, n = ones + zeros, all_ones + all_zeros
    total = part(ones, both * all_ones / n) + part(zeros, both * all_zeros / n)
    total += part(all_ones - ones, (n - both) * all_ones / n) + part(all_zeros - zeros, (n - both) * all_zeros / n)
    return np.where(ones * all_zeros > zeros * all_ones, 2 * total, 0.0)


def _telling(flat, ends, size, owner, word, y, least):
    """The features with a likelihood ratio of ``least`` or more: ``flat[ends[w]:ends[w + 1]]`` are those of word w."""
    import numpy as np

    counts = np.zeros((2, size), np.int32)
    cuts = np.searchsorted(owner, np.arange(len(y) + 1))
    for n, label in enumerate(y):
        own = word[cuts[n] : cuts[n + 1]]
        sizes = ends[own + 1] - ends[own]
        at = np.arange(sizes.sum()) + np.repeat(ends[own] - np.cumsum(sizes) + sizes, sizes)
        counts[int(label), np.unique(flat[at])] += 1
    some = np.flatnonzero(counts[1])
    return some[_ratio(counts[1, some].astype(float), counts[0, some].astype(float), y.sum(), len(y) - y.sum()) >= least]


def _chosen(vocabulary, words, docs, y, lengths, ratio):
    """N-grams with weights: their names, and which words have which.

    A first count is of hashed n-grams, which takes little memory; those of the
    buckets that stand out are counted by name.
    """
    import zlib
    from array import array

    import numpy as np

    pairs = np.unique(docs.astype(np.int64) * len(vocabulary) + words)
    owner, word = (pairs // len(vocabulary)).astype(np.int32), (pairs % len(vocabulary)).astype(np.int32)
    del pairs

    def features(number) -> tuple:
        flat, ends = array("i"), array("q", [0])
        for w in vocabulary:
            flat.extend({k for g in grams(w, lengths) if (k := number(g)) is not None})
            ends.append(len(flat))
        return np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.frombuffer(ends, np.int64)

    out = set(_telling(*features(lambda g: zlib.crc32(g) % BUCKETS), BUCKETS, owner, word, y, ratio).tolist())
    names: dict[bytes, int] = {}
    flat, ends = features(lambda g: names.setdefault(g, len(names)) if zlib.crc32(g) % BUCKETS in out else None)
    keep = _telling(flat, ends, len(names), owner, word, y, ratio)
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    has = place[flat] >= 0
    every = list(names)
    return [every[k] for k in keep], np.repeat(np.arange(len(vocabulary)), np.diff(ends))[has], place[flat[has]]


def fit(bags: Iterable[tuple[Sequence[bytes], int]], share: float | None = None, steps: int = STEPS, lengths: Sequence[int] = LENGTHS, ratio: float = RATIO) -> Model:
    """Maximum likelihood of the labels of ``(words, label)`` bags under the noisy-or, with a small L2 penalty.

    ``share``: of label 1 among all labelled documents, where the bags hold the
    classes in another proportion.  Without one of the classes nothing has a
    weight, and all scores are 0.
    """
    import numpy as np

    vocabulary: dict[bytes, int] = {_BREAK: -1}
    words, sents, docs, labels = [], [], [], []
    n = 0
    for bag, label in bags:
        tokens = np.fromiter((vocabulary.setdefault(w, len(vocabulary) - 1) for w in bag), np.int32, len(bag))
        ids = np.cumsum(tokens < 0)[tokens >= 0]
        if not len(ids):
            continue
        ids = np.concatenate([[0], np.cumsum(np.diff(ids) > 0)])
        words.append(tokens[tokens >= 0])
        sents.append((ids + n).astype(np.int32))
        n += int(ids[-1]) + 1
        docs.append(np.full(int(ids[-1]) + 1, len(labels), np.int32))
        labels.append(label)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -750.0, tuple(lengths))
    del vocabulary[_BREAK]
    words, sents, docs = np.concatenate(words), np.concatenate(sents), np.concatenate(docs)
    names, who, what = _chosen(list(vocabulary), words, docs[sents], y, lengths, ratio)
    # the other words weigh nothing
    weighs = np.zeros(len(vocabulary), bool)
    weighs[who] = True
    words, sents = words[weighs[words]], sents[weighs[words]]
    # nor do sentences without any that does
    some, sents = np.unique(sents, return_inverse=True)
    docs, n = docs[some], len(some)
    share = y.mean() if share is None else min(max(share, 1e-6), 1 - 1e-6)
    cost = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        value = np.bincount(who, theta[what], len(vocabulary))
        z = np.bincount(sents, value[words], n) + theta[-1]
        soft = np.logaddexp(0, z)
        total = np.maximum(np.bincount(docs, soft, len(y)), 1e-12)
        pull = np.where(y > 0, 1 / np.expm1(np.minimum(total, 700)), -1.0) * cost
        dz = pull[docs] * np.exp(z - soft)
        grad = np.append(np.bincount(what, np.bincount(words, dz[sents], len(vocabulary))[who], len(names)), dz.sum())
        grad[:-1] -= PENALTY * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta += STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(dict(zip(names, theta[:-1].tolist(), strict=True)), float(theta[-1]), tuple(lengths))


def _bags(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for row in range(batch.num_rows):  # a row at a time: texts may be very long
            words = b" ".join(_words(texts[row].as_py() or b""))
            columns = [pa.array([words], pa.binary()), pa.array([len(words)], pa.int64()), batch.column(1).slice(row, 1), batch.column(2).slice(row, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["words", "size", "label", "id"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """A model fitted on at most ``sample`` documents of each label, those with the smallest hashed ids, and ``SAMPLE_BYTES`` of their words.

    ``labels(id_col, label_col)`` marks some of ``docs``; rows without an id or a
    label of 0 or 1 are left out, and of several labels the largest counts.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    count = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("id", F.lit(7))
    some = [known.where(F.col("label") == k).orderBy(order, "id").limit(sample) for k in (0, 1)]
    # at most twice the sample: broadcast, so that the documents aren't shuffled
    picked = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(picked, "id").select("text", "label", "id").mapInArrow(_bags, "words binary, size long, label int, id long")
    share = count.get(1, 0) / max(1, sum(count.values()))
    # the sample is cut out by all tasks at once; its documents come one by one, each a string of bytes, of which the fit keeps numbers
    rows = written(rows, "labelled")
    sizes = rows.select("label", "size", "id", order.alias("place")).orderBy("label", "place", "id", "size").select("label", "size").collect()  # numbers of at most twice the sample
    left, last = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, {0: 0, 1: 0}
    for r in sizes:
        left[r.label] -= r.size
        last[r.label] += left[r.label] >= 0
    first = Window.partitionBy("label").orderBy("place", "id", "size", "words")
    ranked = rows.withColumn("place", order).withColumn("rank", F.row_number().over(first))
    few = ranked.where(F.col("rank") <= F.when(F.col("label") == 1, last[1]).otherwise(last[0])).orderBy("label", "rank").select("words", "label")
    return fit(((bytes(r.words).split(), r.label) for r in few.toLocalIterator()), share)


def _scored(batches, model, threshold):
    import numpy as np
    import pyarrow as pa

    model = model.value
    weights = _Weights(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        scores, counts, found = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        at = 0
        while at < batch.num_rows:
            first, parts, ends, n, read = at, [], [], 0, 0
            while at < batch.num_rows and read < CHUNK:
                text = texts[at].as_py() or b""
                words = _words(text) + [_BREAK]
                parts.append(np.fromiter((weights[w] for w in words), float, len(words)))
                n += words.count(_BREAK)
                ends.append(n)
                read += len(text)
                at += 1
            z = model.sentences(np.concatenate(parts))
            ends = np.array(ends)
            starts = np.concatenate([[0], ends[:-1]])
            scores[first:at] = -np.expm1(-np.add.reduceat(np.where(z >= np.log(LEAST / (1 - LEAST)), np.logaddexp(0, z), 0.0), starts))
            counts[first:at] = np.add.reduceat((z > -np.inf).astype(np.int64), starts)
            bad = np.flatnonzero(z >= 0)
            for doc in np.unique(np.searchsorted(ends, bad, "right")):
                pieces = np.frombuffer((texts[first + doc].as_py() or b"").translate(_BYTES) + _BREAK, np.uint8) == 1
                stop = np.flatnonzero(pieces)
                start = np.concatenate([[0], stop[:-1] + 1])
                for s in bad[(bad >= starts[doc]) & (bad < ends[doc])] - starts[doc]:
                    p = float(1 / (1 + np.exp(-z[starts[doc] + s])))
                    found[first + doc].append({"start": int(start[s]), "end": int(stop[s]), "score": p})
        scores = np.clip(scores, 0.0, 1.0)
        skip = int(batch.schema.names[0] == "_text")  # the text goes back only where it is carried
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[skip:], pa.array(scores), pa.array(counts), pa.array(found, spans)],
            [*batch.schema.names[skip:], "score", "n_sentences", "offending"],
        )


def scored(docs: DataFrame, model: Model, text_col: str = "text", carry: Iterable[str] = ("doc_id",), suffix: str = "") -> DataFrame:
    """``(*carry, score, n_sentences, offending)`` for every row of ``docs``.

    ``score``: the noisy-or of all sentences of the whole text with a probability of ``LEAST`` or more, 0 for null, empty
    and wordless texts; ``offending``: byte ranges and probabilities of the
    sentences at 0.5 or more.  Rows repeated in ``docs`` each give a row.
    ``suffix`` ends the names of the three columns, which give way to carried ones
    of their names by underscores.
    """
    carry = list(carry)
    # a carried text isn't sent twice
    own = carry.index(text_col) if text_col in carry and docs.schema[text_col].dataType == T.StringType() else None
    first = F.col(text_col).cast("string").alias("_text" if own is None else f"_c{own}")
    out = docs.select(first, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry) if i != own])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(out, int(own is None), "score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
    got = out.mapInArrow(lambda b: _scored(b, sent, 0.5), schema)
    names = ("score", "n_sentences", "offending")
    own = [F.col(c).alias(n) for c, n in zip(names, free(names, carry, suffix), strict=True)]
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *own)
