"""Exact deduplication, mixing and decontamination against DuckDB, with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontamination, exact_dedup, mixing

SCHEMA = "doc_id long, text string, source string, recipe string, target int, words string"


def odd_documents(spark, path):
    r = random.Random(8)
    long = "".join(r.choice(["word. ", "other ", "é\n", "x"]) for _ in range(4000))
    rows = [(1, None, "b"), (2, "", None), (3, "a b  c", "a"), (4, "a b  c", "b"), (5, long, "a"), (6, long, "c"), (7, long + "!", "c"), (8, " \t\n", "b"), (9, "A b  c", None), (10, "z" * 5000, "d")]
    rows += [(100 + i, f"text {i % 7} of some words", f"s{i % 5}") for i in range(60)]
    spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_exact_dedup(spark, tmp_path, same_as_oracle):
    d = odd_documents(spark, tmp_path)
    same_as_oracle(exact_dedup.op9_exact_dedup(spark, d), exact_dedup.ORACLE, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_chunks_join_to_the_text(spark):
    r = random.Random(9)
    rows = [("".join(r.choice("ab.\né🙂 ") for _ in range(r.randint(0, 5000))),) for _ in range(30)] + [("a" * 5000,)]
    df = spark.createDataFrame(rows, "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for x in df.collect():
        assert "".join(x.c) == x.text and all(len(c) <= exact_dedup.CHUNK_MAX for c in x.c)


def test_colliding_identifiers_fall_back_to_the_chunk(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda c: F.encode(F.substring(c, 1, 3), "UTF-8"))
    df = spark.createDataFrame([(1, "same start one"), (2, "same start two"), (3, "same start one"), (4, "other")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_mixing(spark, tmp_path, same_as_oracle):
    d = odd_documents(spark, tmp_path)
    same_as_oracle(mixing.op10_mixing(spark, d), mixing.ORACLE, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    plan = mixing.schedule(docs).collect()
    assert sum(x.words for x in plan) == sum(r.taken for r in rows)
    assert [x.position for x in plan] == sorted(x.position for x in plan) and 0 <= plan[0].position and plan[-1].position <= 1
    assert len(plan) == sum(r.copies for r in rows)


def test_schedules_follow_their_trend(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    half = mixing.mixed(docs).groupBy("source").agg(F.avg((F.col("position") < 0.5).cast("int")).alias("early")).collect()
    early = {r.source: r.early for r in half}
    assert early["0"] > 0.55 and abs(early["1"] - 0.5) < 0.05 and early["2"] < 0.45


BENCH = [(1, "one two three four five six seven eight nine ten"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, "..."), (6, "One two three four five six seven EIGHT"), (None, "null item text of eight words in all"), (2, "alpha beta")]


def test_decontamination(spark, tmp_path, same_as_oracle):
    r = random.Random(10)
    parts = [t for _, t in BENCH if t] + ["filler words", "two three four five", "é É", "alpha-beta", "gamma", "zeta"]
    rows = [(i, r.choice([" ", "; "]).join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(200)] + [(500, None), (501, ""), (502, "one two three four five six seven")]
    spark.createDataFrame([(i, t, "s", "r", 1, "w") for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    same_as_oracle(decontamination.op3_decontamination(spark, str(tmp_path)), decontamination.ORACLE, str(tmp_path))


def test_decontamination_of_texts_that_share_an_id_or_have_none(spark):
    docs = spark.createDataFrame([(None, "alpha beta x"), (None, "gamma"), (None, "gamma alpha beta"), (7, "gamma"), (7, "alpha beta"), (7, "alpha beta"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in decontamination.hits(docs, items).collect()), key=str)
    want = [(None, 3, 2, 1, False), (None, 1, 1, 1, False), (None, 3, 3, 2, True), (7, 1, 1, 1, False), (7, 2, 2, 1, False), (7, 2, 2, 1, False), (None, 0, 0, 0, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("items", [[], [(1, "..."), (2, None)]])
def test_no_benchmark(spark, items):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = decontamination.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in got) == [(1, 2, 0, 0, False), (2, 0, 0, 0, False)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == mixing.mixed(docs).count() == decontamination.hits(docs, bench).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "s"), (3, "a b", "s"), (3, "a b", "s"), (None, "c d", None)], "doc_id long, text string, source string")
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup.drop_exact_copies(docs).count() == 4  # rows without an id can't be told apart and stay
    assert sum(r.taken for r in mixing.mixed(docs).collect()) == 8
