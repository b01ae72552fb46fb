"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words, hashed to 2**BITS buckets; a document has each of its terms once. The
machine scores bias + sum of weights + sum over pairs of the inner products of the terms' factors,
so it learns that two terms together say more than each alone. It is fitted on the driver to at
most SAMPLE labelled documents of either class (a documented bound; the classes' true shares set the
bias). Only buckets that occur in MIN_DOCS sampled documents take part, the KEEP ones with
the most uneven shares; they are counted on the executors, so the driver gets KEEP numbers and of each sampled document at
most KEEP terms. More than that many terms only fit the sample's noise (at sf0.1, of held-out toxic documents 4,096
terms catch 0.68 and 1,024 catch 0.90). All documents are scored in Arrow batches by a broadcast model of bounded size.

Defined results: null or empty texts have no terms and get the score of the bias. Without labels
the score is the smoothed prior 0.25; with one class it is near that class's share. Null doc_ids are scored
too. Repeated rows are scored alike. An empty table gives no rows. Extra columns are ignored by
``scores`` and carried by ``drop_toxic``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common, labelled

BITS = 22
SAMPLE = 6000
MIN_DOCS = 4
KEEP = 1024
FACTORS = 6
EPOCHS = 12
#: How far the bias goes from the sample's shares of classes to the true ones, and what a missed document costs in false alarms.
TRUE_SHARES = 0.4
MISSED_COST = 4
MODULUS, HELD = 5, 0
#: Texts that a worker unpacks at once.
SLICE = 500
WORD = re.compile(r"[^\W_]+")


def terms(text: str, buckets: labelled.Buckets) -> np.ndarray:
    """The text's distinct buckets, ascending."""
    words = set(WORD.findall(text.lower()))
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))


class Machine:
    """Weights of the kept buckets; score() takes a document's buckets."""

    def __init__(self, kept: np.ndarray, bias: float):
        self.kept, self.bias = kept, bias
        self.w = np.zeros(len(kept) + 1, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.02, (len(kept) + 1, FACTORS)).astype(np.float32)
        self.v[-1] = 0

    def columns(self, buckets: np.ndarray) -> np.ndarray:
        """Positions of the document's kept buckets, then that of the constant term."""
        at = np.searchsorted(self.kept, buckets)
        at = at[self.kept[np.minimum(at, len(self.kept) - 1)] == buckets] if len(self.kept) else at[:0]
        return np.append(at, len(self.kept))

    def raw(self, cols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[cols]
        s = np.add.reduceat(v, starts)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), starts))
        return np.add.reduceat(self.w[cols], starts) + pairs, s

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        cols = [self.columns(r) for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in cols])[:-1]])
        return 1 / (1 + np.exp(-(self.raw(np.concatenate(cols), starts)[0] + self.bias).clip(-30, 30).astype(np.float64)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, rate: float = 0.08, decay: float = 2e-4) -> None:
        """AdaGrad on the logistic loss; the constant term absorbs the sample's own share of classes."""
        cols = [self.columns(r) for r in rows]
        rng, n = np.random.default_rng(11), len(self.w)
        gw, gv = np.full(n, 1e-6, np.float32), np.full((n, FACTORS), 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for b in range(0, len(order), 128):
                batch = order[b : b + 128]
                own = [cols[i] for i in batch]
                lens = np.array([len(c) for c in own])
                flat, starts = np.concatenate(own), np.concatenate([[0], np.cumsum(lens)[:-1]])
                out, s = self.raw(flat, starts)
                err = (1 / (1 + np.exp(-out.clip(-30, 30))) - y[batch]) / len(batch)
                e = np.repeat(err, lens)
                grad_w = np.bincount(flat, e, n)
                each = e[:, None] * (np.repeat(s, lens, 0) - self.v[flat])
                grad_v = np.stack([np.bincount(flat, each[:, f], n) for f in range(FACTORS)], 1)
                grad_v[-1] = 0
                live = np.unique(flat)
                g, h = grad_w[live] + decay * self.w[live], grad_v[live] + decay * self.v[live]
                gw[live] += g * g
                gv[live] += h * h
                self.w[live] -= rate * g / np.sqrt(gw[live])
                self.v[live] -= rate * h / np.sqrt(gv[live]) * (live < n - 1)[:, None]


def fitted(kept: np.ndarray, rows: list[np.ndarray], y: np.ndarray, counts: dict[int, int]) -> Machine:
    """The machine of the kept buckets for sampled rows; counts: labelled documents of each class, from all labels."""
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = (counts.get(1, 0) + 0.5) / (total + 2)
    logit = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return Machine(np.zeros(0, np.int64), logit)
    share = y.mean()
    machine = Machine(kept, 0.0)
    machine.fit(rows, y)
    # The sample is not drawn in the true shares.
    machine.bias = TRUE_SHARES * (logit - float(np.log(share / (1 - share)))) + float(np.log(MISSED_COST))
    return machine


def most_uneven(sampled: DataFrame) -> np.ndarray:
    """The KEEP buckets of (label, terms) whose documents' classes are furthest from the sample's shares, ascending."""
    n, toxic = sampled.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < toxic < n:
        return np.zeros(0, np.int64)
    share = toxic / n
    each = sampled.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos"))
    uneven = F.abs(F.col("pos") - share * F.col("df")) / F.sqrt(F.col("df") * share * (1 - share))
    top = each.where((F.col("df") >= MIN_DOCS) & (uneven > 0)).orderBy(uneven.desc(), "term").limit(KEEP)
    return np.array(sorted(r[0] for r in top.select("term").collect()), np.int64)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine:
    chosen, counts = labelled.sample(labels, "toxic", MODULUS, HELD, bound)

    def extract(batches):
        buckets = labelled.Buckets(BITS)
        for b in batches:
            rows = [terms(t, buckets) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["label", "terms"])

    sampled = common.written(labelled.with_texts(docs, chosen).transform(common.in_workers, extract, "label int, terms array<int>"), "sample")
    kept = most_uneven(sampled)

    def reduce(batches):
        for b in batches:
            rows = [np.intersect1d(np.asarray(x.values), kept, assume_unique=True) for x in b.column("terms")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["label", "terms"])

    got = sampled.transform(common.in_workers, reduce, sampled.schema).toArrow()
    rows = [np.asarray(x, np.int64) for x in got.column("terms").to_pylist()]
    y = np.array(got.column("label").to_pylist(), np.float32)
    order = sorted(range(len(rows)), key=lambda i: (float(y[i]), rows[i].tobytes()))  # whatever order tasks end in
    return fitted(kept, [rows[i] for i in order], y[order], counts)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        buckets, machine = labelled.Buckets(BITS), model.value
        for b in batches:
            s = np.concatenate([machine.score([terms(t, buckets) for t in b.column("text").slice(at, SLICE).to_pylist()]) for at in range(0, max(1, b.num_rows), SLICE)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = common.texts(docs).transform(common.in_workers, run, "doc_id long, score double")
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose own text the machine rejects, whatever their doc_id."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        buckets, machine = labelled.Buckets(BITS), model.value
        for b in batches:
            s = np.concatenate([machine.score([terms(t or "", buckets) for t in b.column("text").slice(at, SLICE).to_pylist()]) for at in range(0, max(1, b.num_rows), SLICE)])
            yield b.filter(pa.array([x < 0.5 for x in s], pa.bool_()))

    return docs.transform(common.in_workers, run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
