"""Removal of repeated 100-byte strings by suffix sorting with a difference cover.

A byte goes when a LENGTH-byte string covers it that also starts earlier (smaller doc_id, or the same
document and an earlier start); strings are judged on the input and never cross documents.

A row for every suffix would be moved several times over, some 16 bytes for each byte of text each
time. Instead suffixes that can be equal for LENGTH bytes are brought together first, and only those are
sorted:

1. Each window of LENGTH bytes has an anchor, the least hash of its GRAM-byte strings (equal windows have
   equal anchors at equal places). Neighbouring windows with one anchor are one context, a row of hashes. Contexts
   are grouped by anchor; of equal contexts all but the first are repeated throughout.
2. Where an anchor stands in different contexts, the bytes of those are fetched. The contexts of an
   anchor are laid end to end, their suffixes are sorted by the difference-cover algorithm (sampled triples are
   sorted and named, names recurse, the other suffixes are merged), and neighbours of the suffix array
   that agree on LENGTH bytes are one string: all but the first occurrence go.
3. An anchor with more than HOT contexts in one worker's share is not gathered anywhere: its windows are sent by
   their own hashes, so its rows spread over all tasks, and each worker first drops what it holds twice.

Defined results: null texts are empty: nothing removed, and kept_sha256 is that of no bytes. A null
doc_id is smaller than all others. A document is a doc_id and a text: rows with both alike are the same strings, not
earlier ones, so they are treated alike; different texts of one doc_id, or without one, are documents in the
order of their hashes. An empty table gives no rows; extra columns are ignored. Texts of any length are worked on
in pieces. Equality of contexts, and of the texts of one doc_id, is that of 64-bit hashes.

In workers a document is its rank among those at hand; what is sent has its doc_id and its text's hash, sub.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common, shingles
from lodestar.llm.suffixes import suffix_array

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
HOT = 32
FLUSH = 1_500_000
#: Buckets for each shuffle partition, at least; and bytes of text for each bucket, at most.
FINE = 4
BUCKET_BYTES = 4_000_000
#: Bytes of a piece of a long text, and of contexts whose suffixes are sorted together.
PIECE = 4_000_000
SORTED = 600_000
BROADCAST_ROWS = 500_000
NO_ID = -(1 << 63)
GONE, CONTEXT, WINDOW, SENT = range(4)
ROWS = "kind int, doc long, sub long, lo long, n long, grp long"
LOW40 = np.uint64((1 << 40) - 1)


class Hasher:
    """Hashes of substrings of a piece of bytes from running sums modulo two primes.

    Modulo a power of two such sums agree for structured strings whatever the base; modulo a prime, n bytes
    that differ agree for at most n bases.
    """

    #: Primes below 2**31, so that products and sums over a piece stay below 2**64; and a base for each.
    FIELDS = ((2147483647, 1299709), (2147483629, 15485863))

    def __init__(self):
        self.up = [np.ones(1, np.uint64)] * 2
        self.down = [np.ones(1, np.uint64)] * 2

    def powers(self, n: int) -> None:
        if len(self.up[0]) < n:
            for table, inverse in ((self.up, False), (self.down, True)):
                for i, (p, base) in enumerate(self.FIELDS):
                    step, out = pow(base, -1, p) if inverse else base, np.ones(1, np.uint64)
                    while len(out) < n:  # by doubling
                        out = np.concatenate([out, out * np.uint64(step) % np.uint64(p)])
                        step = step * step % p
                    table[i] = out

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        self.powers(n + 1)
        run = data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up in self.up:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(run * up[:n], out=total[1:])
            self.sums.append(total)

    def joined(self, parts) -> np.ndarray:
        low, high = (rest(rest(part, p) * down, p) for (part, down), (p, _) in zip(parts, self.FIELDS, strict=True))
        return shingles.mix(low | high << np.uint64(32))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = self.joined((s[hi] - s[lo], d[lo]) for s, d in zip(self.sums, self.down, strict=True))
        return shingles.mix(h + (hi - lo).astype(np.uint64) * shingles.SHORT)

    def every(self, length: int) -> np.ndarray:
        k = len(self.sums[0]) - length
        return self.joined((s[length:] - s[:k], d[:k]) for s, d in zip(self.sums, self.down, strict=True))


def rest(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p; numpy divides by one number much faster than it takes remainders."""
    return x - x // np.uint64(p) * np.uint64(p)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def contexts(hasher: Hasher, data: np.ndarray, ends: np.ndarray):
    """(text, first window, windows, anchor's hash, context's hash) of each context; hasher has loaded data."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    starts = np.concatenate([[0], ends[:-1]])
    long_enough = np.flatnonzero(ends - starts >= LENGTH)
    if not len(long_enough):
        return none
    h = hasher.every(GRAM)
    place = np.uint64((1 << 24) - 1)
    anchor = (sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), SPAN) & place).astype(np.int64)
    counts = (ends - starts)[long_enough] - LENGTH + 1
    text = np.repeat(long_enough, counts)
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[long_enough], counts)
    a = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    k = np.diff(np.append(first, len(a)))
    lo, p = window[first], a[first]
    key = shingles.mix(h[p] ^ np.uint64(0x2545F4914F6CDD1D))
    return text[first], lo, k, key, shingles.mix(hasher.of(lo, lo + k - 1 + LENGTH) + (p - lo).astype(np.uint64))


def pieces(data: np.ndarray, ends: np.ndarray):
    """(number of the first text, offset of the piece in it, bytes, ends): one long text comes in overlapping pieces."""
    if len(ends) == 1 and len(data) > PIECE:
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            yield at, part, np.array([len(part)])
    else:
        yield 0, data, ends


def ranked(ids, subs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents in order, and the rank of each given one."""
    ids, subs = np.asarray(ids, np.int64), np.asarray(subs, np.int64)
    order = np.lexsort((subs, ids))
    new = changes(ids[order], subs[order])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    return ids[order][new], subs[order][new], rank


def blob(ids, subs, doc, *columns) -> bytes:
    """Columns of equal length; documents (doc: their ranks in ids and subs) by a dictionary."""
    found, index = np.unique(doc, return_inverse=True)
    wide = np.uint32 if len(found) > 65535 else np.uint16
    head = np.array([len(doc), len(found)], np.int64).tobytes()
    return b"".join((head, ids[found].tobytes(), subs[found].tobytes(), index.astype(wide).tobytes(), *(c.tobytes() for c in columns)))


def unblob(data: bytes, *kinds) -> list[np.ndarray]:
    """The dictionary's ids and subs, places in it, columns."""
    n, k = (int(x) for x in np.frombuffer(data, np.int64, 2))
    out = [np.frombuffer(data, np.int64, k, 16), np.frombuffer(data, np.int64, k, 16 + 8 * k)]
    at = 16 + 16 * k
    for kind in (np.uint32 if k > 65535 else np.uint16, *kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def pooled(each: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents of several blobs in order, and the rank of the document of each of their rows."""
    ids, subs, rank = ranked(np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]))
    base = np.cumsum([0, *(len(e[0]) for e in each[:-1])])
    return ids, subs, np.concatenate([rank[at : at + len(e[0])][e[2]] for e, at in zip(each, base.tolist(), strict=True)])


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])


def rows_of(kind: int, ids, subs, doc, lo, n, grp=None) -> pa.RecordBatch:
    k = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in (ids[doc], subs[doc], lo, n, np.zeros(k) if grp is None else grp))], ["kind", "doc", "sub", "lo", "n", "grp"])


def changes(*columns) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def later(new: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of sorted groups that start where new is: the rows that aren't at the group's first place."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    return (doc != doc[first]) | (lo != lo[first])


def bucketed(order_by: np.ndarray, buckets: int):
    """(bucket, rows) by the high bits of a hash."""
    bucket = (order_by >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def send_contexts(buckets: int):
    """Texts to blobs of contexts by their anchor's bucket, and rows that need no company."""

    def run(batches):
        hasher, held, own, amount, turn = Hasher(), [], [], 0, TaskContext.get().partitionId() * 104729

        def flush():
            nonlocal turn
            doc, lo, k, key, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            names, subs, rank = ranked(*(np.concatenate(x) for x in zip(*own, strict=True)))
            doc = rank[doc]
            held.clear()
            own.clear()
            order = np.lexsort((lo, doc, ctx, key))
            doc, lo, k, key, ctx = (x[order] for x in (doc, lo, k, key, ctx))
            new = changes(key, ctx)
            again = later(new, doc, lo)
            plain = []
            if again.any():
                plain.append((GONE, doc[again], lo[again], k[again] + LENGTH - 1))
            doc, lo, k, key, ctx = (x[new] for x in (doc, lo, k, key, ctx))
            anchor = changes(key)
            sizes = np.diff(np.append(np.flatnonzero(anchor), len(key)))
            hot = np.repeat(sizes > HOT, sizes)
            if hot.any():
                plain.append((WINDOW, doc[hot], lo[hot], k[hot]))
            keep = ~hot | anchor  # one row of a hot anchor goes on as a sign, with no windows
            k = np.where(hot, 0, k)
            doc, lo, k, key, ctx = (x[keep] for x in (doc, lo, k, key, ctx))
            out = []
            for b, at in bucketed(key, buckets):
                low = key[at] & LOW40
                out.append((b, CONTEXT, blob(names, subs, doc[at], low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8), ctx[at], lo[at].astype(np.int64) if lo[at].max() >> 32 else lo[at].astype(np.uint32), k[at].astype(np.uint8)) + bytes([bool(lo[at].max() >> 32)])))
            for kind, *columns in plain:
                turn += 7919
                out.append((turn % buckets, kind, blob(names, subs, columns[0], *(np.asarray(c, np.int64) for c in columns[1:]))))
            return sent(out)

        for batch in batches:
            ids, subs = batch.column("doc_id").to_numpy(), batch.column("sub").to_numpy()
            for a, z, data, ends in shingles.chunked(batch.column("text")):
                starts = np.concatenate([[0], ends[:-1]])
                base = sum(len(x) for x, _ in own)
                own.append((ids[a:z].copy(), subs[a:z].copy()))  # not a view, which would hold the whole batch
                amount += z - a
                for offset, part, stops in pieces(data, ends):
                    hasher.load(part)
                    text, lo, k, key, ctx = contexts(hasher, part, stops)
                    held.append((base + text, lo - starts[text] + offset, k, key, ctx))
                    amount += len(lo)
                if amount >= FLUSH:
                    yield flush()
                    amount = 0
        if held:
            yield flush()

    return run


def receive_contexts(buckets: int):
    """Blobs of a bucket to rows: GONE stretches, and CONTEXT or WINDOW requests for bytes."""

    def group(bucket, blobs):
        if not blobs:
            return
        each = [unblob(x[:-1], np.uint32, np.uint8, np.uint64, np.int64 if x[-1] else np.uint32, np.uint8) for x in blobs]
        ids, subs, doc = pooled(each)
        low, high, ctx, lo, k = (np.concatenate([e[i].astype(kind) for e in each]) for i, kind in enumerate((np.uint64, np.uint64, np.uint64, np.int64, np.int64), 3))
        key = low | high << np.uint64(32)
        order = np.lexsort((lo, doc, ctx, k == 0, key))
        doc, key, ctx, lo, k = (x[order] for x in (doc, key, ctx, lo, k))
        sign = k == 0
        new = changes(key, ctx, sign)
        again = later(new, doc, lo) & ~sign
        if again.any():
            yield rows_of(GONE, ids, subs, doc[again], lo[again], k[again] + LENGTH - 1)
        doc, key, ctx, lo, k = (x[new] for x in (doc, key, ctx, lo, k))
        anchor = changes(key)
        starts = np.flatnonzero(anchor)
        if not len(starts):
            return
        sizes = np.diff(np.append(starts, len(key)))
        hot = np.repeat(np.logical_or.reduceat(k == 0, starts), sizes)
        for kind, which in ((CONTEXT, np.repeat(sizes > 1, sizes) & ~hot), (WINDOW, hot & (k > 0))):
            if which.any():
                yield rows_of(kind, ids, subs, doc[which], lo[which], k[which], (key[which] * np.uint64(buckets) + np.uint64(bucket)).astype(np.int64))

    def run(batches):
        now, blobs = -1, []
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if bucket != now:
                    yield from group(now, blobs)
                    now, blobs = bucket, []
                if kind == CONTEXT:
                    blobs.append(data)
                else:
                    yield rows_of(kind, *unblob(data, np.int64, np.int64))
        yield from group(now, blobs)

    return run


def send_bytes(buckets: int):
    """Texts with their requests to blobs: contexts by anchor with their bytes, windows by their own hashes."""

    def run(batches):
        hasher, held, windows, own, amount = Hasher(), [], [], [], 0
        turn = TaskContext.get().partitionId() * 104729

        def flush():
            nonlocal turn
            out = []
            names, subs, rank = ranked(*zip(*own, strict=True))
            if held:
                doc, lo, k, grp = (np.concatenate([h[i] for h in held]) for i in range(4))
                doc = rank[doc]
                text = np.concatenate([h[4] for h in held])
                size = k + LENGTH - 1
                start = np.cumsum(size) - size
                for b, at in bucketed(shingles.mix(grp.astype(np.uint64)), buckets):
                    order = at[np.argsort(grp[at], kind="stable")]
                    s = size[order]
                    inside = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(start[order], s)
                    out.append((b, CONTEXT, blob(names, subs, doc[order], lo[order], k[order].astype(np.uint8), grp[order]) + text[inside].tobytes()))
            if windows:
                doc, lo, h = (np.concatenate(x) for x in zip(*windows, strict=True))
                doc = rank[doc]
                order = np.lexsort((lo, doc, h))
                doc, lo, h = doc[order], lo[order], h[order]
                new = changes(h)
                again = later(new, doc, lo)
                if again.any():
                    turn += 7919
                    out.append((turn % buckets, GONE, blob(names, subs, *stretches(doc[again], lo[again]))))
                doc, lo, h = doc[new], lo[new], h[new]
                for b, at in bucketed(h, buckets):
                    out.append((b, WINDOW, blob(names, subs, doc[at], lo[at], h[at])))
            held.clear()
            windows.clear()
            own.clear()
            return sent(out)

        for batch in batches:
            for i, document in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("sub").to_pylist(), strict=True)):
                doc = len(own)
                own.append(document)
                data = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                lo, k, grp, kind = (np.asarray(batch.column(c)[i].values) for c in ("los", "ns", "grps", "kinds"))
                c = kind == CONTEXT
                if c.any():
                    size = k[c] + LENGTH - 1
                    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[c], size)
                    held.append((np.full(int(c.sum()), doc), lo[c], k[c], grp[c], data[inside]))
                    amount += int(size.sum())
                if not c.all():
                    at = np.repeat(lo[~c], k[~c]) + np.arange(int(k[~c].sum())) - np.repeat(np.cumsum(k[~c]) - k[~c], k[~c])
                    for a in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                        some = at[(at >= a) & (at < a + PIECE)]
                        if len(some):
                            hasher.load(data[a : a + PIECE + LENGTH - 1])
                            windows.append((np.full(len(some), doc), some, hasher.of(some - a, some - a + LENGTH)))
                            amount += 24 * len(some)
                if amount >= 16 * FLUSH:
                    yield flush()
                    amount = 0
        if held or windows:
            yield flush()

    return run


def stretches(doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length) of the bytes under windows at these places."""
    order = np.lexsort((lo, doc))
    doc, lo = doc[order], lo[order]
    new = changes(doc, lo - np.arange(len(lo)))
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.diff(np.append(at, len(lo))) + LENGTH - 1


def repeated(doc, lo, k, text) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of some contexts that start earlier in another, by their suffix array.

    k: windows of each context, whose bytes lie end to end in text.
    """
    size = k + LENGTH - 1
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(k)), size)
    inside = np.arange(len(text)) - start[of]
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[inside[order] < k[of[order]]]  # whole windows only
    words = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(8, np.uint8)]), (len(text), 8), (1, 1))
    a, b = order[:-1], order[1:]
    equal = np.arange(len(a))
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        x, y = a[equal] + at, b[equal] + at
        equal = equal[(words[x] == words[y]).all(1)]
    new = np.ones(len(order), bool)
    new[equal + 1] = False
    d, s = doc[of[order]], lo[of[order]] + inside[order]
    group = np.cumsum(new)
    by = np.lexsort((s, d, group))
    d, s, group = d[by], s[by], group[by]
    again = later(changes(group), d, s)
    return d[again], s[again]


def receive_bytes():
    """Blobs of a bucket to GONE rows."""

    def group(blobs, windows):
        if windows:
            each = [unblob(w, np.int64, np.uint64) for w in windows]
            ids, subs, doc = pooled(each)
            lo, h = (np.concatenate([e[i] for e in each]) for i in (3, 4))
            order = np.lexsort((lo, doc, h))
            doc, lo, h = doc[order], lo[order], h[order]
            again = later(changes(h), doc, lo)
            if again.any():
                yield rows_of(GONE, ids, subs, *stretches(doc[again], lo[again]))
        if not blobs:
            return
        each = []
        for x in blobs:
            n, found = (int(i) for i in np.frombuffer(x, np.int64, 2))
            at = 16 + 16 * found + n * (4 if found > 65535 else 2) + n * 17
            each.append((*unblob(x[:at], np.int64, np.uint8, np.int64), np.frombuffer(x, np.uint8, offset=at)))
        ids, subs, doc = pooled(each)
        lo, k, grp, text = (np.concatenate([e[i] for e in each]) for i in range(3, 7))
        k = k.astype(np.int64)
        size = k + LENGTH - 1
        start = np.cumsum(size) - size
        order = np.argsort(grp, kind="stable")
        total = np.cumsum(size[order])
        edges = np.flatnonzero(changes(grp[order]))
        found, a = [], 0
        while a < len(order):  # whole anchors, about SORTED bytes at a time
            i = int(np.searchsorted(total, (total[a - 1] if a else 0) + SORTED))
            j = int(np.searchsorted(edges, max(i, a + 1)))
            z = int(edges[j]) if j < len(edges) else len(order)
            at = order[a:z]
            s = size[at]
            inside = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(start[at], s)
            found.append(repeated(doc[at], lo[at], k[at], text[inside]))
            a = z
        d, s = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(d):
            yield rows_of(GONE, ids, subs, *stretches(d, s))

    def run(batches):
        now, blobs, windows = -1, [], []
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if bucket != now:
                    yield from group(blobs, windows)
                    now, blobs, windows = bucket, [], []
                if kind == GONE:
                    yield rows_of(GONE, *unblob(data, np.int64, np.int64))
                else:
                    (blobs if kind == CONTEXT else windows).append(data)
        yield from group(blobs, windows)

    return run


def cut(batches):
    """Texts with their GONE stretches to n_removed, n_spans and the hash of what is left."""
    for batch in batches:
        out = []
        for doc, sub, text, lo, n in zip(*(batch.column(c) for c in ("doc_id", "sub", "text", "los", "ns")), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            a, b = np.asarray(lo.values), np.asarray(lo.values) + np.asarray(n.values)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((doc.as_py(), sub.as_py(), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("doc", "sub", "n_removed", "n_spans", "kept_sha256"), r, strict=True)) for r in out], pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text), doc_id NO_ID where it is null."""
    return common.texts(docs).fillna({"doc_id": NO_ID}).select("doc_id", F.xxhash64("text").alias("sub"), "text")


def beside(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts joined to lists by document; only the texts needed move when they are few enough to broadcast a hash of each."""
    names = lists.select(F.xxhash64("doc", "sub").alias("name"))
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(names), F.xxhash64(texts["doc_id"], texts["sub"]) == F.col("name"), "left_semi")
    return texts.join(lists.withColumnRenamed("sub", "list_sub"), (texts["doc_id"] == F.col("doc")) & (texts["sub"] == F.col("list_sub")))


def listed(rows: DataFrame, *columns: str) -> DataFrame:
    """doc, sub and, for each column, the array of its values, in one order."""
    packed = rows.groupBy("doc", "sub").agg(F.collect_list(F.struct(*columns)).alias("r"))
    return packed.select("doc", "sub", *(F.col(f"r.{c}").alias(f"{c}s") for c in columns))


def gone_stretches(docs: DataFrame) -> DataFrame:
    """(doc, sub, lo, n): stretches of bytes to remove, overlapping ones included."""
    parts = common.partitions(docs.sparkSession)
    texts = documents(docs)
    buckets = max(FINE * parts, common.text_bytes(texts) // BUCKET_BYTES)
    parts = max(parts, buckets // FINE)
    blobs = texts.transform(common.in_workers, send_contexts(buckets), "bucket int, kind int, data binary")
    rows = common.written(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(common.in_workers, receive_contexts(buckets), ROWS), "contexts")
    wanted = common.written(listed(rows.where(f"kind <> {GONE}"), "lo", "n", "grp", "kind"), "requests")
    near = beside(texts, wanted).select("doc_id", "sub", "text", "los", "ns", "grps", "kinds")
    fetched = near.transform(common.in_workers, send_bytes(buckets), "bucket int, kind int, data binary")
    more = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(common.in_workers, receive_bytes(), ROWS)
    return rows.where(f"kind = {GONE}").select("doc", "sub", "lo", "n").unionByName(more.select("doc", "sub", "lo", "n"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    texts = documents(docs)
    lists = common.written(listed(gone_stretches(docs), "lo", "n"), "gone")
    done = beside(texts, lists).select("doc_id", "sub", "text", "los", "ns").transform(common.in_workers, cut, "doc long, sub long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc", "sub"])
    own = common.texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), F.xxhash64("text").alias("own_sub"))
    found = own.join(done, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (F.col("own_sub") == F.col("sub")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(common.table(spark, sf_dir, "documents"))
