import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import substring_dedup as sd


def brute(rows):
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("hot,piece", [(32, 4_000_000), (2, 1500)])
def test_equals_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "PIECE", piece)
    r = random.Random(hot)
    base = ["".join(r.choices("abcdé ", k=400)) for _ in range(6)]

    def part():
        b, a = r.choice(base), r.randint(0, 380)
        return b[a : a + r.randint(1, 200)]

    rows = [(i, "".join(part() for _ in range(r.randint(0, 8)))) for i in range(120)]
    rows += [(1000, "ab" * 400), (1001, "a" * 500), (1002, ""), (1003, None), (1004, base[0]), (1005, base[0]), (1006, "".join(base) * 3)]
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], "doc_id long, text string, lo int, kind string").repartition(4)
    assert {x[0]: tuple(x)[1:] for x in sd.removed(df).collect()} == brute(rows)


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert sd.removed(spark.createDataFrame([], schema)).collect() == []
    t = "".join(random.Random(1).choices("abcdef", k=300))
    got = sorted(((x.doc_id, x.n_removed) for x in sd.removed(spark.createDataFrame([(None, t), (4, t), (4, t), (5, "x" + t)], schema)).collect()), key=str)
    assert got == sorted([(None, 0), (4, 300), (4, 300), (5, 300)], key=str)


@pytest.mark.parametrize("hot,piece", [(32, 4_000_000), (2, 1500)])
def test_texts_that_share_an_id_or_have_none(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "PIECE", piece)
    r = random.Random(7)
    base = ["".join(r.choices("abcdé ", k=400)) for _ in range(5)]
    texts = ["".join(b[a : a + r.randint(1, 300)] for b, a in ((r.choice(base), r.randint(0, 300)) for _ in range(r.randint(0, 8)))) for _ in range(60)]
    rows = [(r.choice([None, None, 1, 2, 50 + i]), t) for i, t in enumerate(texts)] + [(None, texts[5] * 4), (None, texts[5]), (2, texts[5]), (None, None), (3, "q" * 90), (None, base[0] * 3 + "z")]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = {(x.doc_id, x.text or ""): x.h for x in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ranked = sorted(order, key=lambda d: (d[0] is not None, d[0] or 0, order[d]))
    want = brute(list(enumerate(t for _, t in ranked)))
    want = {d: want[i] for i, d in enumerate(ranked)}
    got = sorted((tuple(x) for x in sd.removed(df).collect()), key=str)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in rows), key=str)
