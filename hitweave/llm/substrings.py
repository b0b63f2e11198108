"""Exact substring dedup: repeated byte strings of a given length, by bucketed suffix sorting.

Only suffixes that can share ``length`` bytes are compared.  Every window of
``length`` bytes has an anchor: its k-gram with the smallest hash, the leftmost
on ties.  Equal windows have equal anchors at equal offsets, so a window's copies
are found among the occurrences of its anchor, and what decides is how far two
occurrences agree to the left and to the right of it.

1. Each partition hashes its texts (polynomial prefix hashes) and picks the
   anchors.  Of occurrences with equal context (all bytes of any window that the
   anchor serves) all but the first of some megabytes are repeats and go no further,
   nor do those of contexts that the task has seen often.  Here bytes are compared.
2. The rest is shuffled by anchor and sorted by context; all but the first
   occurrence of a context are repeats.  The texts aren't at hand here: contexts of
   one anchor are the same if their hashes of 64 bits are.  Anchors with several
   contexts go on.
3. Their contexts are read from the texts, shuffled by anchor, and sorted twice
   in each bucket: what follows the anchor as suffixes, what precedes it as
   reversed prefixes.  The mergesort compares two suffixes by binary search for
   their common extension over prefix hashes; the common extensions of
   neighbours are verified on the bytes.  Windows at offset ``a`` are equal
   where the left extension is at least ``a`` and the right one the rest.
   A bucket of more than ``BUCKET_ROWS`` is split: its offsets into ranges, and the
   occurrences in each by the bytes that all windows of the range hold.  At a single
   offset these are the window itself, and its copies need no sort.
4. Repeats become byte ranges of their documents, joined with the texts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import extended, free, meet, written

#: Bytes of text that are hashed at a time (or one text).
CHUNK = 2 << 20
#: Contexts that are sorted at a time.  A bucket of more is split, its offsets into so many ranges at once.
BUCKET_ROWS, WAYS = 20_000, 4
#: Frequent contexts that a task remembers.
FREQUENT = 10_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base, n):
    import numpy as np

    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def _mix(h):
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _anchors(data, bounds, length, k, powers):
    """Anchors of the texts ``data[bounds[i]:bounds[i + 1]]``.

    Returns each one's text, place, first and last window start (in ``data``),
    the hash of its k bytes and that of its context.
    """
    import numpy as np

    up, down = powers
    w = length - k + 1
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], dtype=np.uint64)])
        grams = _mix((sums[k:] - sums[:-k]) * down[: size - k + 1])
        # the upper half of the hash decides; the place in the lower half breaks ties to the left
        half = np.uint64(32)
        low = ((grams >> half) << half) | np.arange(len(grams), dtype=np.uint64)
        step, best = 1, low
        while 2 * step <= w:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if step < w:
            best = np.minimum(best[: len(best) - (w - step)], best[w - step :])
        place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that lie within one text
        inside = np.zeros(size - length + 1, bool)
        starts, ends = bounds[:-1], bounds[1:] - length + 1
        for s, e in zip(starts[ends > starts].tolist(), ends[ends > starts].tolist(), strict=True):
            inside[s:e] = True
        window = np.flatnonzero(inside)
        if not len(window):
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        place = place[window]
        text = np.searchsorted(bounds, window, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        first, last = window[new], window[np.append(new[1:], len(window)) - 1]
        place, text = place[new], text[new]
        left, right = place - first, last + length - place
        context = _mix((sums[last + length] - sums[first]) * down[first])
        context = _mix(context + _mix((left * 100003 + right).astype(np.uint64)))
        return text, place, first, last, grams[place], context


def _chunks(texts, length):
    """Texts by some megabytes: (rows, offsets, bytes, bounds) of whole texts or, of longer ones, pieces that overlap by all but a byte of ``length``."""
    import numpy as np

    def pieces():
        for row in range(len(texts)):
            text = texts[row].as_py() or b""
            for at in range(0, max(1, len(text) - length + 1), CHUNK):
                yield row, at, text[at : at + CHUNK + length - 1]

    rows, offsets, parts, read = [], [], [], 0
    for row, at, part in pieces():
        rows.append(row)
        offsets.append(at)
        parts.append(part)
        read += len(part)
        if read >= CHUNK:
            yield np.array(rows), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            rows, offsets, parts, read = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class _Powers:
    """Powers of the base and of its inverse, for texts as long as were seen."""

    def __init__(self):
        self.n = 0

    def __call__(self, n):
        if n > self.n:
            self.n = max(n, 2 * CHUNK)
            self.pair = _powers(_BASE, self.n), _powers(_INVERSE, self.n)
        return self.pair


_ROWS = "anchor long, context long, id long, row long, place int, first int, last int"


def _same_bytes(data, a, b, sizes):
    """Whether data[a:a + size] equals data[b:b + size], for each."""
    import numpy as np

    out = np.ones(len(a), bool)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        n = sizes[at:end]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(a[at:end], n) + step] != data[np.repeat(b[at:end], n) + step]
        out[at:end] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        at = end
    return out


class _Frequent:
    """First occurrences of contexts that a task has met more than once, so that of a passage that all texts share one row a task goes on."""

    def __init__(self):
        self.known = {}

    def __call__(self, grams, context, id_, place, slices, often):
        """Which rows repeat what is known, later in the order of documents; learns from rows that are ``often``."""
        import numpy as np

        repeat = np.zeros(len(grams), bool)
        if self.known:
            keys = np.array(list(self.known), np.uint64)
            for n in np.flatnonzero(np.isin(context, keys)).tolist():
                gram, head, where, text = self.known[int(context[n])]
                if gram == int(grams[n]) and text == slices(n):
                    here = (int(id_[n]), int(place[n]))
                    if (head, where) < here:
                        repeat[n] = True
                    else:
                        self.known[int(context[n])] = (gram, *here, text)
        for n in np.flatnonzero(often & ~repeat).tolist():
            if len(self.known) >= FREQUENT:
                break
            self.known.setdefault(int(context[n]), (int(grams[n]), int(id_[n]), int(place[n]), slices(n)))
        return repeat


def _listed(batches, length, k):
    """Rows of ``_ROWS`` for (id, row, text); repeats of what the task has seen have a null anchor."""
    import numpy as np
    import pyarrow as pa

    powers, frequent = _Powers(), _Frequent()
    for batch in batches:
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for numbers, offsets, data, bounds in _chunks(batch.column(2).cast(pa.binary()), length):
            text, place, first, last, grams, context = _anchors(data, bounds, length, k, powers(len(data)))
            if not len(text):
                continue
            start, size = first, last + length - first
            base = bounds[text] - offsets[text]
            id_, row = ids[numbers[text]], rows[numbers[text]]
            place, first, last = place - base, first - base, last - base
            order = np.lexsort((place, id_, context, grams))
            same = np.concatenate([[False], (grams[order][1:] == grams[order][:-1]) & (context[order][1:] == context[order][:-1])])
            # a repeat starts later in the order of documents than the first of its run; equal starts (repeated rows) are none
            run = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            later = same & ((id_[order] != id_[order][run]) | (place[order] != place[order][run]))
            at = np.flatnonzero(later)
            mine, theirs = order[at], order[run[at]]
            fits = size[mine] == size[theirs]
            fits[fits] = _same_bytes(data, start[mine[fits]], start[theirs[fits]], size[mine[fits]])
            repeat, often = np.zeros(len(order), bool), np.zeros(len(order), bool)
            repeat[mine[fits]] = True
            often[theirs[fits]] = True
            out = [grams.view(np.int64), context.view(np.int64), id_, row, place.astype(np.int32), first.astype(np.int32), last.astype(np.int32)]
            keep = np.flatnonzero(~repeat)
            repeat[keep] = frequent(grams[keep], context[keep], id_[keep], place[keep], lambda n: data[start[keep[n]] : start[keep[n]] + size[keep[n]]].tobytes(), often[keep])
            keep = ~repeat
            arrays = [pa.array(x[keep]) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, _names())
            # the repeats of one text as few ranges of windows
            some = np.flatnonzero(repeat)
            some = some[np.lexsort((first[some], text[some]))]
            if len(some):
                t, f, l = text[some], first[some], last[some]
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] > l[:-1] + 1)])
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(t)) - 1
                none = pa.nulls(len(s), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, pa.array(id_[some][s]), pa.array(row[some][s]), pa.nulls(len(s), pa.int32()), pa.array(f[s].astype(np.int32)), pa.array(l[e].astype(np.int32))],
                    _names(),
                )


def _names():
    return [x.split()[0] for x in _ROWS.split(", ")]


def _sifted(batches):
    """Of rows sorted by (anchor, context, id, place): repeats with a null anchor, and the firsts of anchors with several contexts.

    Keeps one row: the first of an anchor, until it is known whether it has another context.
    """
    import numpy as np
    import pyarrow as pa

    held = None  # (anchor, context, id, place of the context's first; the anchor's first row if it is still to be sent)
    for batch in batches:
        if not batch.num_rows:
            continue
        null = np.array(batch.column(0).is_null())
        if null.any():
            yield batch.filter(pa.array(null))
            batch = batch.filter(pa.array(~null))
            if not batch.num_rows:
                continue
        anchor, context, id_, _, place, _, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held is not None:
            anchor, context, id_, place = (np.concatenate([[h], x]) for h, x in zip(held[:4], (anchor, context, id_, place), strict=True))
        skip = int(held is not None)
        if held is None:
            waiting = None
        else:
            waiting = held[4]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeat = (id_ != id_[run]) | (place != place[run])
        group = np.cumsum(new_anchor) - 1
        contexts = np.bincount(group, new).astype(np.int64)
        if held is not None and waiting is None:
            contexts[0] += 1  # its first context went on before
        # copies of the very same row (repeated rows) go on with their context's first
        several = ~repeat & (contexts[group] > 1)
        if waiting is not None and contexts[0] > 1:
            yield _renulled(waiting, False)
            waiting = None
        mine = slice(skip, None)
        if repeat[mine].any():
            yield _renulled(batch.filter(pa.array(repeat[mine])), True)
        if several[mine].any():
            yield batch.filter(pa.array(several[mine]))
        last = len(anchor) - 1
        if contexts[group[last]] > 1:
            waiting = None
        else:
            tail = ~repeat & (group == group[last])
            own = batch.filter(pa.array(tail[mine]))
            if group[last] == 0 and waiting is not None:
                waiting = pa.Table.from_batches([waiting, own]).combine_chunks().to_batches()[0] if own.num_rows else waiting
            else:
                waiting = own
        held = (anchor[last], context[last], id_[run[last]], place[run[last]], waiting)


def _renulled(batch, repeats):
    import pyarrow as pa

    if not repeats:
        return batch
    none = pa.nulls(batch.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *batch.columns[2:]], batch.schema.names)


_FRAGMENTS = "anchor long, id long, row long, place int, first int, last int, left binary, right binary"


def _fragments(batches):
    """The bytes before and from each wanted anchor on, as far as its windows reach."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        ids, rows, wanted = batch.column(0), batch.column(1), batch.column(3)
        out = [[] for _ in range(8)]
        for n in range(batch.num_rows):
            text = texts[n].as_py() or b""
            for x in wanted[n].as_py():
                place, first, last = x["place"], x["first"], x["last"]
                for column, value in zip(
                    out, (x["anchor"], ids[n].as_py(), rows[n].as_py(), place, first, last, text[first:place], text[place : last + x["length"]]), strict=True
                ):
                    column.append(value)
            if len(out[0]) > 20_000 or n + 1 == batch.num_rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _FRAGMENTS.split(", ")])
                out = [[] for _ in range(8)]


class _Suffixes:
    """Strings as a matrix of bytes with prefix hashes: their common extensions and their order."""

    def __init__(self, strings):
        import numpy as np

        self.sizes = np.array([len(s) for s in strings], np.int64)
        width = int(self.sizes.max(initial=0))
        self.bytes = np.zeros((len(strings), width + 1), np.uint8)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        row = np.repeat(np.arange(len(strings)), self.sizes)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.bytes[row, column] = flat
        up = _powers(_BASE, width)
        with np.errstate(over="ignore"):
            self.hashes = np.zeros((len(strings), width + 1), np.uint64)
            np.cumsum((self.bytes[:, :width].astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, dtype=np.uint64, out=self.hashes[:, 1:])

    def common(self, a, b):
        """Lengths of the common extensions of strings a and b: binary search over the prefix hashes."""
        import numpy as np

        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a, b, ties):
        """Whether string a sorts before b; of equal ones, ``ties``."""
        import numpy as np

        n = self.common(a, b)
        end_a, end_b = n >= self.sizes[a], n >= self.sizes[b]
        return np.where(end_a & end_b, ties, np.where(end_a, True, np.where(end_b, False, self.bytes[a, n] < self.bytes[b, n])))

    def sort(self, group):
        """Mergesort within the groups, which stand one after the other: an order of all strings."""
        import numpy as np

        n = len(group)
        order = np.arange(n)
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(firsts, n))
        start, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            live = np.flatnonzero(size > width)
            own = live - start[live]
            mine = own // width
            left = mine % 2 == 0
            other = start[live] + np.where(left, mine + 1, mine - 1) * width
            end = np.minimum(other + width, start[live] + size[live])
            base = start[live] + (mine - mine % 2) * width
            low, high = np.minimum(other, end), end.copy()
            for _ in range(int(width).bit_length()):  # how many of the other run come first
                open_ = low < high
                if not open_.any():
                    break
                at = np.flatnonzero(open_)
                middle = (low[at] + high[at]) >> 1
                before = self.less(order[middle], order[live[at]], ~left[at])
                low[at] = np.where(before, middle + 1, low[at])
                high[at] = np.where(before, high[at], middle)
            rank = low - np.minimum(other, end) + own % width
            merged = order.copy()
            merged[base + rank] = order[live]
            order = merged
            width *= 2
        return order

    def classes(self, group):
        """The order of all strings, and for each the common extension with the one before it in its group (-1: none)."""
        import numpy as np

        order = self.sort(group)
        lcp = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1 if len(order) else np.zeros(0, np.int64)
        a, b = order[same - 1], order[same]
        lcp[same] = self.common(a, b)
        # hashes may collide: neighbours must agree byte by byte as far as they say, and stand in order
        for at in range(0, len(same), 1 << 16):
            cut = slice(at, at + (1 << 16))
            x, y, n = a[cut], b[cut], lcp[same[cut]]
            differ = self.bytes[x] != self.bytes[y]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
            ordered = np.where(n >= self.sizes[x], True, (n < self.sizes[y]) & (self.bytes[x, n] < self.bytes[y, n]))
            if (first < n).any() or not ordered.all():
                return self._exactly(group)
        return order, lcp

    def _exactly(self, group):
        """The same without hashes, where they collide."""
        import numpy as np

        strings = [self.bytes[i, :n].tobytes() for i, n in enumerate(self.sizes.tolist())]
        order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i], i)), np.int64)
        lcp = np.full(len(order), -1, np.int64)
        for n, (i, j) in enumerate(zip(order[:-1].tolist(), order[1:].tolist()), 1):
            if group[i] == group[j]:
                x, y = strings[i], strings[j]
                lcp[n] = next((m for m, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return order, lcp


def _repeats(batches, length, rows):
    """Ranges of repeated windows, of fragments sorted by anchor."""
    import numpy as np
    import pyarrow as pa

    def solve(table):
        anchor, id_, row, place, first, last = (table.column(i).to_numpy() for i in range(6))
        group = np.cumsum(np.concatenate([[False], anchor[1:] != anchor[:-1]]))
        right = _Suffixes(table.column(7).to_pylist())
        left = _Suffixes([x[::-1] for x in table.column(6).to_pylist()])
        (ro, rl), (lo, ll) = right.classes(group), left.classes(group)
        most = place - first
        least = place - last
        # documents in order: the first of a class is the one that stays
        order = np.lexsort((place, id_))
        rank = np.empty(len(order), np.int64)
        new = np.concatenate([[True], (id_[order][1:] != id_[order][:-1]) | (place[order][1:] != place[order][:-1])])
        rank[order] = np.cumsum(new) - 1
        hit = [[], []]
        for a in range(int(least.min()), int(most.max()) + 1):
            some = (least <= a) & (a <= most)
            if some.sum() < 2:
                continue
            r, l = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
            r[ro], l[lo] = np.cumsum(rl < length - a), np.cumsum(ll < a)
            at = order[some[order]]  # in the order of documents, which a stable sort keeps
            both = r[at] * (len(group) + 1) + l[at]
            by = np.argsort(both, kind="stable")
            at, both = at[by], both[by]
            new = np.concatenate([[True], both[1:] != both[:-1]])
            head = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            later = rank[at] > rank[head]
            hit[0].append(at[later])
            hit[1].append(place[at[later]] - a)
        if not hit[0]:
            return None
        item, start = np.concatenate(hit[0]), np.concatenate(hit[1]).astype(np.int64)
        if not len(item):
            return None
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] > start[:-1] + 1)])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(item)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(id_[item[s]]), pa.array(row[item[s]]), pa.array(start[s].astype(np.int32)), pa.array(start[e].astype(np.int32))],
            ["id", "row", "first", "last"],
        )

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column(0).to_numpy()
        cut = int((anchor != anchor[-1]).sum())  # sorted: the last bucket may go on in the next batch
        if not cut:
            continue
        got = solve(table.slice(0, cut).combine_chunks())
        if got is not None:
            yield got
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        got = solve(pa.Table.from_batches(held).combine_chunks())
        if got is not None:
            yield got


def _kept(batches, length):
    import hashlib

    import numpy as np
    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, ranges = batch.column(0).cast(pa.binary()), batch.column(1)
        sizes, digests, found = np.zeros(batch.num_rows, np.int64), [], []
        for n in range(batch.num_rows):
            text = texts[n].as_py() or b""
            sizes[n] = len(text)
            here: list[list[int]] = []
            for x in sorted((x["first"], x["last"]) for x in ranges[n].as_py() or ()):
                if here and x[0] <= here[-1][1]:
                    here[-1][1] = max(here[-1][1], x[1] + length)
                else:
                    here.append([x[0], x[1] + length])
            digest, at = hashlib.sha256(), 0
            for s, e in here:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            digests.append(digest.hexdigest())
            found.append([{"start": s, "end": e} for s, e in here])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(sizes), pa.array(found, spans), pa.array(digests, pa.string())],
            [*batch.schema.names[2:], "n_bytes", "removed", "kept_sha256"],
        )


_RANGES = "id long, row long, first int, last int"


def _split(fragments: DataFrame, length: int, high: int, rows: int, solved) -> Iterable[DataFrame]:
    """Ranges of repeated windows of the fragments of buckets that are too large, windows at offsets 0 to ``high``.

    All windows at offsets from ``low`` to ``high`` hold ``low`` bytes before the anchor
    and ``length - high`` from it on, so equal ones meet in a bucket by these bytes.
    """
    levels = [(fragments, 0, high)]
    while levels:
        here, low, high = levels.pop()
        step = -(-(high - low + 1) // WAYS)
        for a, b in ((a, min(high, a + step - 1)) for a in range(low, high + 1, step)):
            mine = here.where((F.col("place") - F.col("last") <= b) & (F.col("place") - F.col("first") >= a)).select(
                "anchor", "id", "row", "place", F.greatest("first", F.col("place") - b).alias("first"), F.least("last", F.col("place") - a).alias("last"), "left", "right"
            )
            mine = mine.select(
                "anchor", "id", "row", "place", "first", "last",
                F.expr("substring(left, length(left) - (place - first) + 1, place - first)").alias("left"), F.expr(f"substring(right, 1, last + {length} - place)").alias("right"),
            )
            shared = [F.expr(f"substring(left, length(left) - {a} + 1, {a})"), F.expr(f"substring(right, 1, {length - b})")]
            mine = written(mine.withColumn("anchor", F.xxhash64("anchor", F.lit(a), *shared)), "split")
            large = written(mine.groupBy("anchor").count().where(F.col("count") > rows).select("anchor"), "heavy")
            if not large.limit(1).count():
                yield solved(mine)
                continue
            yield solved(mine.join(large, "anchor", "left_anti"))
            rest = mine.join(large, "anchor", "left_semi")
            if a < b:
                levels.append((written(rest, "fragments"), a, b))
                continue
            windows = written(rest.select("id", "row", (F.col("place") - a).alias("first"), F.concat("left", "right").alias("window")), "windows")
            least = windows.groupBy("window").agg(F.min(F.struct("id", "first")).alias("least"))
            later = meet(windows, least, "window").where(F.struct("id", "first") > F.col("least"))
            yield later.select("id", "row", "first", F.col("first").alias("last"))


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int | None = None, rows: int = BUCKET_ROWS,
    carry: Iterable[str] = ("doc_id",), suffix: str = "",
) -> DataFrame:
    """``(*carry, n_bytes, removed, kept_sha256)`` for every row of ``docs``.

    ``removed``: the maximal byte ranges (of the text in UTF-8) covered by strings
    of ``length`` bytes that also start earlier: under a smaller id, or under the
    same id at a smaller place.  A null or empty text has no bytes; rows with a
    null id come last and are one document; rows that repeat an id are one
    document too, in which equal places aren't earlier, so that a row repeated
    as a whole loses nothing to itself.  ``k``: bytes of an anchor; ``rows``: of a
    bucket that is sorted at once.  ``suffix`` ends the names of the three columns,
    which give way to carried ones of their names by underscores.
    """
    k = k or max(1, length // 2)
    if not 0 < k <= length:
        raise ValueError("an anchor is as long as the string or shorter")
    carry = list(carry)
    # a row is known by its id and text: rows equal in both are treated alike
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(text_col).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    listed = texts.select("id", "row", "text").mapInArrow(lambda b: _listed(b, length, k), _ROWS)
    spread = F.coalesce("anchor", F.xxhash64("id", "first"))
    sifted = written(
        listed.repartition(spread).sortWithinPartitions("anchor", "context", "id", "place").mapInArrow(_sifted, _ROWS), "anchors"
    )
    ranges = sifted.where("anchor is null").select("id", "row", "first", "last")
    several = sifted.where("anchor is not null").select("anchor", "id", "row", "place", "first", "last")
    heavy = written(several.groupBy("anchor").count().where(F.col("count") > rows).select("anchor"), "heavy")
    some = heavy.limit(1).count() > 0

    def wanted(anchors: DataFrame) -> DataFrame:
        """The texts with their wanted anchors; with all columns, so that one shuffle of the texts serves all uses."""
        item = F.struct("anchor", "place", "first", "last", F.lit(length).alias("length"))
        return texts.join(anchors.groupBy("id", "row").agg(F.collect_list(item).alias("wanted")), ["id", "row"]).select(
            "id", "row", "text", "wanted", *[f"_c{i}" for i in range(len(carry))]
        )

    def solved(fragments: DataFrame) -> DataFrame:
        return fragments.repartition("anchor").sortWithinPartitions("anchor", "id", "place").mapInArrow(lambda b: _repeats(b, length, rows), _RANGES)

    ranges = ranges.unionByName(solved(wanted(several.join(heavy, "anchor", "left_anti") if some else several).mapInArrow(_fragments, _FRAGMENTS)))
    if some:
        for part in _split(written(wanted(several.join(heavy, "anchor", "left_semi")).mapInArrow(_fragments, _FRAGMENTS), "fragments"), length, length - k, rows, solved):
            ranges = ranges.unionByName(part)
    found = ranges.groupBy("id", "row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    out = texts.join(found, ["id", "row"], "left").select("text", "ranges", *[f"_c{i}" for i in range(len(carry))])
    schema = extended(out, 2, "n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string")
    got = out.mapInArrow(lambda b: _kept(b, length), schema)
    own = ("n_bytes", "removed", "kept_sha256")
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(n) for c, n in zip(own, free(own, carry, suffix), strict=True)])
