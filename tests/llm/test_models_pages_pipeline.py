"""The classifiers' held-out accuracy, page extraction, and the pipeline against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import html_text, labelled, pii, quality, token_counts, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(spark, scored, target):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    met = scored.where("held_out").join(labels, "doc_id")
    return met.agg(F.avg((F.col("predicted") == F.col(target)).cast("int")), F.avg(F.when(F.col(target) == 1, F.col("predicted"))), F.avg(F.when(F.col(target) == 0, F.col("predicted")))).first()


def test_toxicity_held_out(spark):
    right, caught, alarms = accuracy(spark, toxicity.op2_toxicity(spark, SF), "toxic")
    assert right > 0.95 and caught > 0.7 and alarms < 0.01


def test_toxicity_scores_are_the_sums_over_all_pairs():
    r = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(10, 40, 3), -0.3)
    machine.w, machine.v = r.normal(size=machine.w.shape), r.normal(size=machine.v.shape)
    machine.v[-1] = 0
    rows = [np.unique(r.integers(0, 50, k)) for k in (0, 1, 2, 7, 30)]
    for row, got in zip(rows, machine.score(rows), strict=True):
        at = [*(machine.kept.tolist().index(x) for x in row.tolist() if x in machine.kept), len(machine.kept)]
        want = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(at) for j in at[:n])
        assert got == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-6)


def test_toxicity_learns_what_only_pairs_tell(spark):
    """Neither word tells anything alone: documents are toxic where the insult meets the group, or the praise the foe."""
    r = random.Random(4)
    rows = []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = ["insult" if a else "praise", "group" if b else "foe", *(f"filler{r.randrange(200)}" for _ in range(8))]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("held_out").join(df, "doc_id").collect()
    assert len(held) > 500 and sum(x.predicted == x.toxic for x in held) > 0.97 * len(held)
    machine = toxicity.learn(df, df)
    machine.v[:] = 0
    buckets = labelled.Buckets(toxicity.BITS)
    alone = machine.score([toxicity.terms(x.text, buckets) for x in held])
    assert sum((s >= 0.5) == (x.toxic == 1) for s, x in zip(alone, held, strict=True)) < 0.65 * len(held)


def test_quality_held_out(spark):
    right, kept, wrong = accuracy(spark, quality.op7_quality(spark, SF), "quality")
    assert right > 0.95 and kept > 0.97 and wrong < 0.05


def test_votes_are_those_of_the_nearest_by_similarity():
    r = random.Random(6)
    terms = quality.Terms()
    text = lambda good: " ".join(r.choice(["calm", "word", "prose", "text"] if good else ["X9", "!!", "##", "text"]) + str(r.randrange(20)) for _ in range(r.randint(1, 40)))
    sample = [terms(text(i % 3 > 0)) for i in range(80)]
    voters = quality.Voters(sample, np.array([float(i % 3 > 0) for i in range(80)]), {0: 30, 1: 170})
    asked = [terms(text(i % 2)) for i in range(30)] + [terms("")]

    def place(row):
        cols, counts = row
        w = [float(np.log1p(n)) * float(voters.idf[c]) for c, n in zip(cols.tolist(), counts.tolist(), strict=True)]
        norm = sum(x * x for x in w) ** 0.5 or 1.0
        e = sum((x / norm * voters.directions[c].astype(float) for x, c in zip(w, cols.tolist(), strict=True)), np.zeros(voters.directions.shape[1]))
        return e / max(float(np.linalg.norm(e)), 1e-9)

    for row, got in zip(asked, voters.score(asked), strict=True):
        e = place(row)
        cosines = [float(e @ v) for v in voters.vectors.astype(float)]
        nearest = sorted(range(80), key=lambda i: -cosines[i])[: quality.NEAREST]
        votes = [(max(cosines[i], 0) * float(voters.weights[i]), float(voters.labels[i])) for i in nearest]
        mass = sum(w for w, _ in votes)
        assert got == pytest.approx(sum(w * y for w, y in votes) / mass if mass > 1e-12 else voters.prior, abs=1e-4)


def test_shapes_are_of_the_whole_word():
    shapes = quality.Both(quality.BITS)
    low = (1 << quality.BITS) - 1
    stem = "a1" * 20
    assert shapes[stem + "{};"] & low != shapes[stem + "B=7"] & low
    assert shapes["x" * 40 + "!"] & low == shapes["yz!"] & low


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_models_on_odd_rows(spark, module, column):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "word", "x"), (3, "a " * 30000, "x"), (3, "a " * 30000, "x")], "doc_id long, text string, score string")
    few = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = few.where("false")
    for labels in (few, none):
        got = module.scores(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert module.scores(docs.where("false"), none).collect() == []


def test_other_operators_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a@b.cd", 2), (None, "a@b.cd", 2)], "doc_id long, text string, n_email int")
    assert sorted(r.n_email for r in pii.found_in(docs).collect()) == [0, 1, 1]
    assert sorted(r.n_tokens for r in token_counts.counted(docs).collect())[0] == 0
    assert pii.found_in(docs.where("false")).collect() == token_counts.counted(docs.where("false")).collect() == []


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>First  part<br>goes<p>on <b>and</b>on.</article><footer>f</footer>", "T & U First part goes on andon."),
    ("<div class='top-nav'><a href=/>Home</a></div><div id=main><p>Some words that make up the text of the page, enough of them.</p><p>And a second paragraph that goes on.</p></div><div class=comments><p>I think that this comment is longer than the whole page, and it goes on and on and on and on and on and on.</p></div>", "Some words that make up the text of the page, enough of them. And a second paragraph that goes on."),
    ("<article><h1>A</h1><p>Body text here.</p><script>var a='<p>no</p>';</script><style>p{}</style><form><input value=x>Search</form><aside>Side</aside><section class='reader-comments'><p>Nice</p></section></article>", "A Body text here."),
    ("<body><div class=ad>Buy</div><!-- <p>hidden</p> --><main><p>Caf&eacute; &#8364; x</p></main>", "Café € x"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("a < b and <b>c", "a < b and c"),
    ("<p>unclosed <a href='x>text", "unclosed text"),  # a quote that never closes ends with its tag
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div class='content has-sidebar'><p>The main text stands here, and it goes on.</p><div class=sidebar><p>Not this.</p></div></div><div class=footer>f</div>", "The main text stands here, and it goes on."),
        ("<div id=no-sidebar><article><p>Body text here.</p></article></div>", "Body text here."),
        ("<article class='post category-legal tag-search'><h1>A</h1><p>Body text here.</p></article>", "A Body text here."),
        ("<div class=page-search><main><p>Body text here.</p></main></div>", "Body text here."),
        ("<article><p>Body text here, the one that counts.</p></article><ol class=commentlist><li><article class=comment-body><p>Nice one.</p></article></ol>", "Body text here, the one that counts."),
    ],
)
def test_class_words_do_not_cut_the_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    began = time.time()
    assert html_text.main_text("<div>" * 20000 + "x") == "x"
    assert html_text.main_text("<p>" * 50000 + "words") == "words"
    assert "<a b" not in html_text.main_text("<p>some words" + "<a b='" * 2000)
    assert time.time() - began < 20


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, None, "<p>hello there"), (None, "u", None), (None, "u", None)], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_text.extracted(df).collect()) == [("", 0), ("", 0), ("hello there", 11)]


def test_pipeline_against_brute_force(spark):
    from tests.llm.test_ngram_join import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {r.doc_id: r.text for r in toxicity.scores(docs, labels).where("predicted = 0").join(docs, "doc_id").collect()}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in last.items()}
    found = brute(list(left.items()))
    left = {i: t for i, t in left.items() if found[i][1] == i}
    from lodestar.llm import decontamination

    frame = docs.where(F.col("doc_id").isin(list(left)))
    dirty = {r.doc_id for r in decontamination.hits(frame, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(left) - dirty
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_filters_judge_rows_without_an_id_or_with_a_shared_one(spark):
    from lodestar.llm import decontamination

    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("vile nasty hateful " if i % 2 else "calm gentle pleasant ") * 5) for i in range(40)]
    rows += [(None, rows[1][1]), (None, rows[0][1]), (90, rows[1][1]), (90, rows[0][1]), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and not kept.where("text LIKE 'vile%'").count()
    assert kept.where("text LIKE 'calm%'").count() == 22
    items = spark.createDataFrame([(1, "vile nasty"), (2, "nasty hateful")], "item_id long, text string")
    assert decontamination.drop_contaminated(docs, items).where("text LIKE 'vile%'").count() == 0
    assert decontamination.drop_contaminated(docs, items).where("text LIKE 'calm%'").count() == 22


def test_stage_columns_and_empty_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>hello there", "clash", 9)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extracted(df).select("page_id", "url", "text", "n_chars").collect()] == [(1, "u", "hello there", 11)]


def test_stages_on_odd_rows(spark, tmp_path):
    """Every stage on rows without id or text, repeated rows, ties and columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, sub long, position double"
    long = "some plain words that go on " * 8
    rows = [(None, None), (None, long), (5, long), (5, long), (6, "kind words, few of them"), (6, ""), (7, "one two three four five six seven eight nine, alpha beta gamma delta epsilon zeta eta theta")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, "x", 3, 0.5) for i, t in rows], schema)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    bench = [(1, "one two three four five six seven eight"), (2, "alpha beta gamma delta epsilon zeta eta theta")]
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        left[name] = sorted((str(x.doc_id), x.text or "") for x in got.collect())
    every = sorted((str(i), t or "") for i, t in rows)
    assert left["toxicity"] == every
    assert left["exact_dedup"] == every  # rows without an id, and copies that share one, can't be told apart
    assert left["ngram_join"] == [x for x in every if x != ("None", long)]
    assert left["decontamination"] == [x for x in every if x[0] != "7"]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(mixed) == len(rows) and sum(x.taken for x in mixed) == sum(x["size"] for x in mixed)
