"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words and word shapes (case, digits, trailing signs), plus a few marks of the whole text
(shares of distinct words and lines, of words that repeat the one before, of the commonest word), hashed to 2**BITS columns with weight log(1 + tf) * idf. A
truncated SVD of the labelled sample gives RANK directions; the sample's unit vectors (at most
SAMPLE of either class, a documented bound) are broadcast. Every document is projected, its cosines with all
of them are computed in blocks, and its NEAREST neighbours vote with their similarity;
classes weigh by their share in all labels.

Defined results: an empty or null text has only the marks of an empty text and is scored like any other; a
text with no direction at all gets the prior. Without labels the score is the smoothed prior 0.5.
Null doc_ids are scored too; repeated rows alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common, labelled

BITS = 14
SAMPLE = 1500
RANK = 48
NEAREST = 25
MODULUS, HELD = 3, 1
BLOCK = 512
#: A mark counts as so many occurrences of a term.
MARK = 20
RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0"))


class Both(labelled.Buckets):
    """word -> bucket of the word and bucket of its shape, in one number.

    Shapes: runs of capitals, small letters and digits become A, a and 0; signs stay.
    """

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            shape = "a" if word.islower() else "A" if word.isupper() else "Aa" if word[1:].islower() else "m"
        else:
            shape = word
            for run, sign in RUNS:
                shape = run.sub(sign, shape)
        own = labelled.Buckets.__missing__(self, word)
        found = self[word] = own << BITS | zlib.crc32(b"\x01" + shape.encode("utf-8", "surrogatepass")) & self.mask
        return found


def tenths(part: int, whole: int) -> int:
    """part / whole in tenths, -1 of nothing."""
    return 10 * part // whole if whole else -1


class Terms:
    """text -> (columns, counts), hashed; words are remembered up to a bound."""

    def __init__(self):
        self.words = Both(BITS)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        n = len(tokens)
        both = np.fromiter(map(self.words.__getitem__, tokens), np.int64, n)
        lines = [x for x in text.split("\n") if x.strip()]
        again = int((both[1:] == both[:-1]).sum())
        _, most = np.unique(both, return_counts=True)
        marks = (f"d{tenths(len(most), n)}", f"l{tenths(len(set(lines)), len(lines))}", f"n{min(12, n.bit_length())}", f"r{tenths(again, n)}", f"m{tenths(int(most.max()) if n else 0, n)}")
        marked = np.repeat([zlib.crc32(b"\x00" + m.encode()) & self.words.mask for m in marks], MARK)
        return np.unique(np.concatenate([both >> BITS, both & self.words.mask, marked]), return_counts=True)


class Voters:
    """idf, directions, unit vectors of the sample and their weights and labels."""

    def __init__(self, rows: list, y: np.ndarray, counts: dict[int, int]):
        total = counts.get(0, 0) + counts.get(1, 0)
        self.prior = (counts.get(1, 0) + 0.5) / (total + 1)
        self.vectors = None
        if len(rows) < 2 or len(np.unique(y)) < 2:
            return
        dim = 1 << BITS
        df = np.bincount(np.concatenate([c for c, _ in rows]), minlength=dim)
        self.idf = (np.log((1 + len(rows)) / (1 + df)) * (df > 1)).astype(np.float32)
        m = np.zeros((len(rows), dim), np.float32)
        for i, (c, n) in enumerate(rows):
            m[i, c] = self.weigh(c, n)
        rng = np.random.default_rng(3)
        q = rng.normal(size=(dim, min(RANK + 8, len(rows)))).astype(np.float32)
        for _ in range(3):
            q = np.linalg.qr(m.T @ np.linalg.qr(m @ q)[0])[0]
        _, _, vt = np.linalg.svd(m @ q, full_matrices=False)
        self.directions = np.ascontiguousarray((q @ vt[:RANK].T).astype(np.float32))
        self.vectors = unit(m @ self.directions)
        self.labels = y.astype(np.float32)
        share = y.mean()
        self.weights = np.where(y > 0, self.prior / share, (1 - self.prior) / (1 - share)).astype(np.float32)

    def weigh(self, cols, counts):
        w = np.log1p(counts).astype(np.float32) * self.idf[cols]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def score(self, rows: list) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(rows), self.prior)
        out = np.empty(len(rows))
        k = min(NEAREST, len(self.labels))
        for b in range(0, len(rows), BLOCK):
            some = rows[b : b + BLOCK]
            e = np.stack([self.weigh(c, n) @ self.directions[c] for c, n in some])
            cosine = unit(e) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) * self.weights[near]
            mass = w.sum(1)
            out[b : b + len(some)] = np.where(mass > 1e-12, (w * self.labels[near]).sum(1) / np.maximum(mass, 1e-12), self.prior)
        return out.clip(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Voters:
    chosen, counts = labelled.sample(labels, "quality", MODULUS, HELD, bound)

    def extract(batches):
        terms = Terms()
        for b in batches:
            rows = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["label", "cols", "counts"])

    got = labelled.with_texts(docs, chosen).transform(common.in_workers, extract, "label int, cols array<int>, counts array<int>").toArrow()
    rows = sorted(((y, np.asarray(c, np.int64), np.asarray(n, np.int64)) for y, c, n in zip(*(got.column(x).to_pylist() for x in ("label", "cols", "counts")), strict=True)), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    return Voters([r[1:] for r in rows], np.array([r[0] for r in rows], np.float64), counts)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        terms, voters = Terms(), model.value
        for b in batches:
            texts, s = b.column("text"), []
            for at in range(0, len(texts), BLOCK):
                s.append(voters.score([terms(t) for t in texts.slice(at, BLOCK).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *s]), pa.float64())], ["doc_id", "score"])

    scored = common.texts(docs).transform(common.in_workers, run, "doc_id long, score double")
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
