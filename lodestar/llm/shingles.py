"""Sets of word shingles of many texts at once, as sorted 64-bit hashes (numpy, for Python workers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Bytes of text worked on together; one longer text is worked on alone.
CHUNK = 2_000_000
#: Bytes of a word that are hashed in numpy, eight at a time; longer words are hashed one by one.
LONG_WORD = 64
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SHORT = np.uint64(0x1D8E4E27C47D124F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of data: every eight bytes are mixed into a state that starts from the size."""
    out = mix(size.astype(np.uint64) * SHORT)
    eights = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    at = np.flatnonzero(size <= LONG_WORD)
    lo, left = start[at], size[at]
    while len(at):
        kept = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        out[at] = mix(out[at] ^ ((eights[lo] << kept) >> kept))
        more = left > 8
        at, lo, left = at[more], lo[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return out


class Shingler:
    """Shingle sets of chunks of texts."""

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and words of each text; data: the texts' bytes, ends: where each text ends."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        data = LOWER[data]
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = ends[(ends > 0) & (ends < n)]
        first[cuts] = inside[cuts]  # a word never goes on in the next text
        last[cuts - 1] = inside[cuts - 1]
        a, z = np.flatnonzero(first), np.flatnonzero(last)
        counts = np.diff(np.searchsorted(a, ends), prepend=0)
        return hashed(data, a, z + 1 - a), counts

    def sets(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All shingles, text after text, each text's distinct and ascending; and how many each has."""
        w, counts = self.words(data, ends)
        stops = np.cumsum(counts)
        total = len(w)
        n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
        out = np.empty(int(n.sum()), np.uint64)
        full = np.zeros(max(total - SHINGLE + 1, 0), np.uint64)
        for j in range(SHINGLE):
            full += w[j : j + len(full)] * PLACES[j]
        full = mix(full)
        at, kept = 0, np.zeros(len(ends), np.int64)
        for i, (c, stop) in enumerate(zip(counts.tolist(), stops.tolist(), strict=True)):
            if c >= SHINGLE:
                s = full[stop - c : stop - SHINGLE + 1]
                s.sort()
                if len(s) > 1:
                    fresh = np.empty(len(s), bool)
                    fresh[0] = True
                    np.not_equal(s[1:], s[:-1], out=fresh[1:])
                    s = s[fresh]
            elif c:
                s = mix((w[stop - c : stop] * PLACES[:c]).sum(keepdims=True) + SHORT * np.uint64(c))
            else:
                continue
            kept[i] = len(s)
            out[at : at + len(s)] = s
            at += len(s)
        return out[:at].copy(), kept


def chunked(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, ends) of pieces of at most about CHUNK bytes; texts has no nulls."""
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to
