import random

import numpy as np
import pytest

from lodestar.llm import ngram_join as nj
from lodestar.llm import shingles, substring_dedup


def brute(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed, families, passages):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(40))
    shared = [[word() for _ in range(r.choice((12, 40)))] for _ in range(passages)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.choice((6, 20, 60, 150)))] + r.choice(shared)
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), (" " if r.random() < 0.5 else "\n").join(w)))
    return rows


@pytest.mark.parametrize("small,longest", [(8, 4096), (2, 4096), (32, 3)])
def test_equals_brute_force(spark, monkeypatch, small, longest):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "LONGEST", longest)
    rows = texts(small, 40, 2)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a\tB"), (1005, "one two three four five"), (1006, "x " * 3000), (1007, rows[0][1])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, node string, n_shingles int").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.joined(df).collect()} == brute(rows)


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert nj.joined(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "lonely words here"), (7, None)]
    got = sorted(map(tuple, nj.joined(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 1, None), (7, 0, 7)], key=str)
    kept = nj.keep_one_of_each(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "other")], schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_schemes_cover_every_pair():
    for s in [*range(1, 80), 137, 500, 2001]:
        for t in range(s, 4 * s // 3 + 1):
            both = {x[0]: x for x in nj.schemes_of(s)}.keys() & {x[0] for x in nj.schemes_of(t)}
            band = nj.schemes_of(t)[0][0]
            assert band in both
            for x in (s, t):
                _, parts, used, slack = next(y for y in nj.schemes_of(x) if y[0] == band)
                assert parts >= used >= (s + t) // 7 + 1 + slack


def thue_morse(n):
    """A word of n letters and its complement, on which sums modulo a power of two agree whatever their base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ turn] for b in bits) for turn in (0, 1)]


@pytest.mark.parametrize("n", [8, 64, 65, 1024, 65536])
def test_structured_words_have_their_own_hashes(n):
    data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
    sets, counts = shingles.Shingler().sets(data, np.array([n, 2 * n]))
    assert counts.tolist() == [1, 1] and sets[0] != sets[1]
    hasher = substring_dedup.Hasher()
    hasher.load(data)
    a, b = hasher.of(np.array([0, n]), np.array([n, 2 * n]))
    assert a != b


def test_hashes_are_of_the_bytes_alone():
    texts = ["a bc defghijk lmnopqrstuvw " + "x" * 64 + " " + "y" * 65, "a bc defghijk lmnopqrstuvw " + "x" * 64 + " " + "y" * 65 + " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    words, counts = shingles.Shingler().words(data, np.array([len(texts[0]), len(data)]))
    assert counts.tolist() == [6, 7] and words[:6].tolist() == words[6:12].tolist() and len(set(words.tolist())) == 7
    r = np.random.default_rng(1).integers(97, 99, 5000).astype(np.uint8)
    hasher, again = substring_dedup.Hasher(), substring_dedup.Hasher()
    hasher.load(r)
    again.load(r[1000:])
    assert (hasher.every(100)[1000:] == again.every(100)).all()
    assert len(set(hasher.every(100).tolist())) == len({r[i : i + 100].tobytes() for i in range(4901)})


def test_large_families_settle_without_pairs(spark):
    """2,000 near copies of one text, from mild edits to such as link with some copies only, beside unlike texts that share a passage."""
    r = random.Random(5)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(400))
    base, passage = [word() for _ in range(120)], [word() for _ in range(20)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(3000 + i, " ".join([*(word() for _ in range(r.randint(30, 60))), *passage])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in nj.joined(df).collect()} == brute(rows)


def test_keep_one_of_each_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "other text"), (4, "x y z u v w"), (4, "X y z u v w"), (4, "far from it"), (9, "x y z u v w"), (None, ""), (7, None)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string")
    kept = nj.keep_one_of_each(df)
    assert kept.columns == df.columns
    texts = sorted(x.text.lower() if x.text else str(x.text) for x in kept.collect())
    assert texts == sorted(["a b c d e f", "other text", "x y z u v w", "far from it", "", "None"])


def test_small_intermediates_are_few_files(spark, monkeypatch, tmp_path):
    """A file for each shuffle partition of every round costs executors a writer's buffers and three processes apiece."""
    from lodestar.llm import common
    from lodestar.sources import shared

    for module in (common, shared):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    usual = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = texts(7, 30, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.joined(df).collect()}
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    files = {}
    for d in tmp_path.glob("lodestar-*"):
        files.setdefault(d.name.split("-")[1], []).append(len(list(d.glob("part-*.parquet"))))
    assert max(files["signatures"]) <= nj.TASKS * spark.sparkContext.defaultParallelism < 30
    assert {"nodes", "edges", "labels", "verified", "unsettled"} <= files.keys()
    assert {k: max(files[k]) for k in files.keys() & {"nodes", "edges", "labels", "verified", "unsettled", "across", "meetings"} if max(files[k]) > 1} == {}


def test_gathered_keeps_large_tables_as_they_are(spark):
    from lodestar.sources import shared

    df = spark.range(0, 1000, 1, 7)
    assert shared.gathered(df, 3 * shared.FILE_ROWS).rdd.getNumPartitions() == 3
    assert shared.gathered(df, 4 * shared.FILE_ROWS) is df  # as many as the shuffle partitions
    assert shared.gathered(df.where("id < 0"), 0).rdd.getNumPartitions() == 1
