"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

The vectors are dealt to shards.  In a shard, the values of each dimension are
quantised by magnitude and sign into levels; the vectors of one level and
dimension, with their values, are a posting segment.  A query takes the
segments of all dimensions by descending quantised impact: the largest product
that the level allows.  It adds each segment's products to the scores so far.
What is left of a dimension bounds what its vectors may still get, so all scores
are known up to the sum of these bounds.  The query stops when the vectors that
can still be among its k best are proven to be few, or when no segment is left;
those vectors are rescored exactly.

Each shard is built once for up to ``BLOCK`` queries, which stream past it.  Vectors
with components too large for sums in 64 bits stand beside the index, in Python's integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of one shard, and queries that pass a shard in one task.
SHARD, BLOCK = 32_768, 65_536
#: A shard has no fewer vectors than this for the sake of more tasks.
LEAST = 4_096
#: Levels of each dimension and sign.
LEVELS = 5
#: Sums of products are kept below this in 64-bit integers; what may exceed it is computed in Python's integers.
EXACT = 1 << 62


class Shard:
    """The index of some integer vectors: their posting segments by dimension and level.

    ``large``: (id, vector) of those whose components don't fit, compared one by one.
    """

    def __init__(self, ids, vectors, large=(), levels: int = LEVELS):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.large = ids[order], vectors[order], large
        n, dims = self.vectors.shape
        self.largest = int(np.abs(self.vectors).max(initial=0))
        dim, parts, values, low, high = [], [], [], [], []
        for d in range(dims):
            column = self.vectors[:, d]
            step = int(np.abs(column).max(initial=0)) // levels + 1
            level = np.sign(column) * (np.abs(column) // step + 1)
            by = np.argsort(level, kind="stable").astype(np.int32)
            cuts = np.flatnonzero(np.diff(level[by])) + 1
            for part in np.split(by, cuts):
                if len(part) and column[part[0]] != 0:
                    dim.append(d)
                    parts.append(part)
                    values.append(column[part])
                    low.append(values[-1].min())
                    high.append(values[-1].max())
        self.dim, self.parts, self.values = np.array(dim, np.int64), parts, values
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)

    def members(self, query, k: int):
        """Rows that may be among the k best of ``query``: a proof excludes all others."""
        import numpy as np

        n, dims = self.vectors.shape
        if n <= 8 * k or not len(self.dim):
            return np.arange(n)
        weight = query[self.dim]
        a, b = weight * self.low, weight * self.high
        order = np.argsort(-np.maximum(np.abs(a), np.abs(b)), kind="stable")
        least, most = np.minimum(a, b)[order], np.maximum(a, b)[order]
        dim = self.dim[order]
        checks = {len(order) * i // 16 for i in range(6, 16)}
        scores = np.zeros(n, np.int64)
        for at, s in enumerate(order.tolist()):
            if at in checks:  # what the segments left over may add: in each dimension, at most one of them or nothing
                add, take = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
                np.maximum.at(add, dim[at:], most[at:])
                np.minimum.at(take, dim[at:], least[at:])
                bar = np.partition(scores, n - k)[n - k] + take.sum()
                rows = np.flatnonzero(scores + add.sum() >= bar)
                if len(rows) <= max(8 * k, n // 16):
                    return rows
            if weight[s]:
                scores[self.parts[s]] += weight[s] * self.values[s]
        return np.flatnonzero(scores >= np.partition(scores, n - k)[n - k])

    def best(self, query: list[int], k: int, own: int) -> list[tuple[int, int]]:
        """(score, id) of the k best whose id isn't ``own``, ties to smaller ids."""
        import numpy as np

        if self.largest * sum(map(abs, query)) < EXACT and max(map(abs, query), default=0) < EXACT:
            q = np.array(query, np.int64)
            mine = int(np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left"))
            rows = self.members(q, min(len(self.ids), k + mine)) if len(self.ids) else np.zeros(0, np.int64)
            rows = rows[self.ids[rows] != own]
            scores = self.vectors[rows] @ q
            order = np.lexsort((self.ids[rows], -scores))[:k]
            got = list(zip(scores[order].tolist(), self.ids[rows[order]].tolist(), strict=True))
        else:
            got = [(_product(v, query), i) for i, v in zip(self.ids.tolist(), self.vectors.tolist(), strict=True) if i != own]
        if self.large or len(got) > k:
            got += [(_product(v, query), i) for i, v in self.large if i != own]
            got.sort(key=lambda x: (-x[0], x[1]))
        return got[:k]


def _product(a, b):
    return sum(x * y for x, y in zip(a, b))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product isn't a finite double."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


def _shard(ids, vectors, scale):
    """A shard of lists of doubles."""
    import numpy as np

    width = max(map(len, vectors), default=0)
    limit = math.isqrt(EXACT // max(1, width))
    fits = [all(abs(x) * scale < limit for x in v) for v in vectors]
    matrix = np.zeros((sum(fits), width), np.int64)
    for row, v in enumerate(v for v, ok in zip(vectors, fits, strict=True) if ok):
        matrix[row, : len(v)] = np.floor(np.array(v) * scale)
    large = [(i, [_whole(x, scale) for x in v]) for i, v, ok in zip(ids, vectors, fits, strict=True) if not ok]
    return Shard(np.array([i for i, ok in zip(ids, fits, strict=True) if ok], np.int64), matrix, large)


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _sortable(score: int) -> str:
    """Orders scores that have the same nearest 64-bit integer."""
    if _LEAST <= score <= _MOST:
        return "5"
    digits = str(abs(score))
    if score > 0:
        return f"9{len(digits):06d}{digits}"
    return f"1{10**6 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


_ANSWERS = "query_id long, key long, vec_id long, score long, over string"


def _answers(batches, k, scale):
    """Answers of runs of rows (shard, block, key, id, vector), those of the shard before its queries, which have a key."""
    import pyarrow as pa

    run, ids, vectors, shard = None, [], [], None
    for batch in batches:
        out = [[] for _ in range(5)]
        shards, blocks, keys, numbers = (batch.column(i).to_pylist() for i in range(4))
        for at, (now, key, number) in enumerate(zip(zip(shards, blocks, strict=True), keys, numbers, strict=True)):
            if now != run:
                run, ids, vectors, shard = now, [], [], None
            vector = batch.column(4)[at].as_py()
            if key is None:
                ids.append(number)
                vectors.append(vector)
                continue
            if shard is None:
                shard = _shard(ids, vectors, scale)
                ids, vectors = [], []
            for score, other in shard.best(([_whole(x, scale) for x in vector] + [0] * shard.vectors.shape[1])[: max(len(vector), shard.vectors.shape[1])], k, number):
                for column, value in zip(out, (number, key, other, min(max(score, _LEAST), _MOST), _sortable(score)), strict=True):
                    column.append(value)
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _ANSWERS.split(", ")])


def search(
    embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query``, the ``k`` other rows of largest inner product.

    Components become ``floor(scale * x)``.  Ties go to the smaller id; with fewer
    candidates there are fewer rows.  Vectors that are null, hold null or non-finite
    components, or have no id take no part; the shorter of two vectors counts as
    filled up with zeros.  All rows with a query's id are its own; other rows that
    repeat an id are candidates each, and queries that repeat a row are answered
    once.  Ranks are exact whatever the components' size; a score that 64 bits
    can't hold is given as the nearest number that they can.  Other columns of
    ``embeddings`` don't matter, whatever their names.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where("id is not null and vector is not null")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards = max(1, -(-n // shard), min(embeddings.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    blocks = max(1, -(-asked // block))

    def dealt(name: str, number: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(number)).cast("int").alias(name)

    def everywhere(name: str, number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    queries = rows.where("is_query").select("id", "vector", F.xxhash64("vector").alias("key")).distinct()
    queries = queries.select(dealt("block", blocks, 1), "key", "id", "vector", everywhere("shard", shards)).select("shard", "block", "key", "id", "vector")
    vectors = rows.select(dealt("shard", shards, 2), F.lit(None).cast("long").alias("key"), "id", "vector", everywhere("block", blocks)).select("shard", "block", "key", "id", "vector")
    some = (
        vectors.unionByName(queries)
        .repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block"))  # a shard and a block for each task, none left over
        .sortWithinPartitions("shard", "block", F.col("key").asc_nulls_first(), "id")
        .mapInArrow(lambda b: _answers(b, k, scale), _ANSWERS)
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
