"""Main text, languages, toxicity, nearest neighbours, exact top-k and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markbook.llm import ann, html_text, language, queries, topk, toxicity

SF = "/root/testdata/sf0.01"


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# --- main text --------------------------------------------------------------------------------

WEIGHTS = html_text.fit(
    [
        f"<html><head><title>t</title></head><body><nav><a href=x>menu here</a></nav><div class='ad'>buy this {i}</div>"
        f"<article><h1>Title {i}</h1><p>Some long text of the article.</p><p>More of it.</p></article>"
        f"<div><a href=y>other page</a> <a href=z>next</a></div><footer>about us</footer></body></html>"
        for i in range(20)
    ]
)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><p>a  b\n c</p><p> d&amp;e &lt;p&gt; &#233;&nbsp;f</p></article>", "a b c\nd&e <p> é f"),
        ("<article><p><b>one<br><p>two</article><footer>no</footer>", "one\ntwo"),
        ("<nav><a>x</a></nav><article><h1>t</h1><aside>no</aside><p>y</p><form><p>no</p></form></article>", "t\ny"),
        ("<article><p>y</p><section class='comments'><p>no</p><p>no no</p></section></article>", "y"),
        ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>", "a\nb"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>a<i>b</i>c <a href='>'>d</a></p></article><p>after it</p>", "abc d"),
        ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
        ("<main><p class='ad'>no</p><p>yes</p><div style='display:none'>no</div></main>", "yes"),
        (
            "<body><ul><li><a>m</a></li><li><a>n</a></li></ul><div><p>first part here</p><p>second part</p></div>"
            "<div class='sidebar'><p>no no</p></div><footer>no</footer></body>",
            "first part here\nsecond part",
        ),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source, WEIGHTS) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div class='content has-sidebar'><article><p>a</p></article></div>", "a"),
        ("<div class='no-sidebar sidebar'><nav>no</nav><article><p>a</p></article></div>", "a"),
        ("<article><h2 id='side-effects'>t</h2><section id='related-work'><p>a</p></section><p id=search-algorithms>b</p></article>", "t\na\nb"),
        ("<article><h2 id='search'>t</h2><section id='comments'><p>a</p></section></article>", "t\na"),
        ("<article><p>a</p><div class='post social'><p>no</p></div><div class=ads>no</div><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><svg-icon>i</svg-icon><p>b</p><select-menu></select-menu><p>c</p></article>", "a\ni\nb\nc"),
        ("<article><p>a <svg viewBox='0 0 1 1' /> b</p><svg/><p>c</p><svg><text>no</text></svg></article>", "a b\nc"),
        ("<article><p>so <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> it is</p></article>", "so x=2 it is"),
    ],
)
def test_names_and_raw_elements_drop_no_main_text(source, text):
    assert html_text.main_text(source, WEIGHTS) == text


BODY = "<div class='post'><p>the body of this page has many words</p><p>and some more of them here</p></div>"
BODY_TEXT = "the body of this page has many words\nand some more of them here"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        # Teasers or comments are the only articles.
        (f"<body>{BODY}<ul class='related'><article><p>a teaser</p></article></ul></body>", BODY_TEXT),
        (f"<body>{BODY}<div class='comments'><article><p>x</p></article><article><p>y</p></article></div></body>", BODY_TEXT),
        # Two parts, and more link words between them than the smaller one has.
        (
            "<article><p>one two three four five</p></article><div><a href=x>" + "go there " * 20 + "</a></div><article><p>six seven</p></article>",
            "one two three four five\nsix seven",
        ),
        # An advert that is longer than the text on either side, without any main element.
        ("<body><div><p>first part here</p><div class='ad'>" + "buy it now " * 20 + "</div><p>second part</p></div></body>", "first part here\nsecond part"),
    ],
)
def test_main_elements_and_word_weights_decide_together(source, text):
    assert html_text.main_text(source, WEIGHTS) == text


def test_region_is_the_best_contiguous_run():
    draw = random.Random(1)
    for _ in range(300):
        x = [draw.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(draw.randrange(12))]
        a, b = html_text.region(x)
        best = max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert sum(x[a:b]) == best and (best > 0 or (a, b) == (0, 0))


def test_pages_with_edge_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>"), (2, None, None), (None, "v", "")]
    rows += [(3, "w", "<article>" + "<p>word word</p>" * 30_000), (4, "x", "<p " * 50_000), (5, "y", "<a b='" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    pages = pages.withColumn("n_chars", F.lit("y"))
    got = sorted((str(r.page_id), r.url, r.n_chars) for r in html_text.extracted(pages).collect())
    assert [g for g in got if g[0] in ("1", "2", "None")] == [("1", "u", 3), ("1", "u", 3), ("2", None, 0), ("None", "v", 0)]
    assert ("3", "w", 30_000 * 10 - 1) in got
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_all_pages_against_their_articles(spark):
    import html
    import re

    for r in queries.op1_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)


# --- languages --------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = docs.join(queries.op7_language(spark, SF), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_edge_rows(spark, documents, no_documents):
    got = language.predicted(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        assert (r.held_out is None) == (r.doc_id is None) and (r.doc_id is None or r.held_out == held_out(r.doc_id))
        if r.doc_id is not None:
            assert (r.lang_pred == "und" and r.score == 0.0) == (r.doc_id in (2, 3, 4))
    assert language.predicted(no_documents).count() == 0
    untrained = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predicted(untrained).collect()} == {"und"}


def test_trigram_vectors_bind_permuted_letters():
    space = language.Space()
    grams, counts = language.trigrams("Abc")
    got = space.bundle(grams, counts)
    want = np.zeros(language.SIZE)
    for a, b, c in (" ab", "abc", "bc "):
        x, y, z = (language.letter_vector(ord(i)).astype(int) for i in (a, b, c))
        want += np.roll(x, 2) * np.roll(y, 1) * z
    assert (got == want).all()


# --- toxicity ---------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = known.join(queries.op9_toxicity(spark, folder), "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    alarms = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    # About half of the toxic documents hold a word that tells at once, the others a root that they repeat.
    assert hits > 0.5 and alarms < 0.01


def test_toxic_roots_of_every_language_are_found(spark):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").select("doc_id")
    langs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = known.join(langs, "doc_id").join(queries.op9_toxicity(spark, folder), "doc_id").where("held_out").collect()
    for lang in ("en", "fr", "de", "es"):
        assert np.mean([r.predicted for r in rows if r.lang == lang]) >= 0.75, lang


def test_segments_that_tell_by_their_uses():
    draw = random.Random(8)
    roots = ["grulpen", "grulp", "pensta", "mirko", "falten", "osda", "trulpe"]

    def text(n, uses):
        words = ["".join(draw.choices(roots, k=2)) for _ in range(n)]
        return " ".join(draw.sample(words + ["zinkalo" + draw.choice(roots) for _ in range(uses)], n + uses))

    texts = [(text(150, 4), 1) for _ in range(80)] + [(text(150, draw.random() < 0.1), 0) for _ in range(300)]
    model = toxicity.train(*zip(*texts))
    meter = toxicity.Meter(model.ordinary, model.toxic, model.repeated, model.phrases)
    found = np.array([meter.savings(t) for t in (text(150, 4), text(150, 1), text(6000, 8), None)], float)
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], toxicity.features(found, model.rates)))
    # Uses are weighed by the length of the text.
    assert model.repeated and (z >= 0).tolist() == [True, False, False, False]


@pytest.mark.parametrize("said", ["off", "river table", "green the door"])
def test_phrases_and_short_words_tell(said):
    draw = random.Random(3)
    words = "river table green the door window carry of stone and paper lamp walks under bright".split()

    def text(n, toxic):
        own = [w for _ in range(n) for w in [draw.choice(words)]]
        own = [w for a, w in zip(["", *own], own) if (a, w) not in {("river", "table"), ("green", "the"), ("the", "door")}]
        at = draw.randrange(len(own))
        return " ".join(own[:at] + [said] * toxic + own[at:])

    texts = [(text(80, 1), 1) for _ in range(80)] + [(text(80, 0), 0) for _ in range(300)]
    model = toxicity.train(*zip(*texts))
    meter = toxicity.Meter(model.ordinary, model.toxic, model.repeated, model.phrases)
    found = np.array([meter.savings(t) for t in (text(80, 1), text(80, 0), " ".join(reversed(said.split())))], float)
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], toxicity.features(found, model.rates)))
    assert (z >= 0).tolist()[:2] == [True, False]


def test_toxicity_of_edge_rows(spark, documents, no_documents):
    labels = spark.createDataFrame([(100 + i, 0, i % 2) for i in range(120)] + [(None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    toxic = documents.withColumn("text", F.when((F.col("doc_id") >= 100) & (F.col("doc_id") % 2 == 1), F.concat("text", F.lit(" wretched scum idiot"))).otherwise(F.col("text")))
    got = toxicity.scored(toxic, labels).collect()
    assert len(got) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id and r.doc_id >= 100 and r.doc_id % 2} == {1}
    assert {r.predicted for r in got if not (r.doc_id and r.doc_id >= 100 and r.doc_id % 2)} == {0}
    assert toxicity.scored(no_documents, labels).count() == 0
    assert {r.score for r in toxicity.scored(documents, labels.limit(0)).collect()} == {0.0}
    assert toxicity.clean(toxic, labels).columns == documents.columns


def test_words_longer_than_a_window_are_seen_whole():
    meter = toxicity.Meter(b" plain words of no harm at all, just plain words " * 20, b" idiot loser moron")
    assert meter.savings("x" * 900 + " idiot")[0] >= 2 and meter.savings("x" * 2000)[0] < 2


# --- vectors ----------------------------------------------------------------------------------


def usable(rows):
    """Smallest vector of an id, without nulls and non-finite components."""
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out[i] = min(out.get(i, v), v)
    return out


def test_exact_top_equals_brute_force(vectors):
    own = usable([(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()])
    ints = {i: [int(np.floor(x * 1024.0)) for x in v] for i, v in own.items()}
    want = set()
    for q in ints:
        if q % 5 == 0:
            scores = [(-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10])}
    assert {tuple(r) for r in topk.nearest(vectors, F.col("vec_id") % 5 == 0).collect()} == want


@pytest.mark.parametrize(("block", "queries_", "probe"), [(7, 3, 15), (50, 1000, 1)])
def test_exact_top_in_small_blocks(vectors, monkeypatch, block, queries_, probe):
    for name, value in {"BLOCK": block, "QUERIES": queries_, "PROBE": probe, "STEEP": 0.1}.items():
        monkeypatch.setattr(topk, name, value)
    test_exact_top_equals_brute_force(vectors)


def test_exact_top_of_large_integers(spark):
    rows = [(i, [float(2**18 + i), -float(2**18 - i)]) for i in range(30)]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    x = [[int(a * 1024) for a in v] for _, v in rows]
    scores = sorted((-(x[0][0] * v[0] + x[0][1] * v[1]), i) for i, v in enumerate(x) if i)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, -s) for s, i in scores[:10]]


def test_neighbours_are_found(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = queries.op5_near_vectors(spark, SF).collect()
    hits = []
    for q in ids[ids % 20 == 0]:
        at = int(np.flatnonzero(ids == q)[0])
        score = ann.products(x[at], x)
        score[at] = -np.inf
        best = set(ids[ann.best(score, ids, 20)])
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {i for _, i, _ in own}
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        assert all(s == score[np.flatnonzero(ids == i)[0]] for _, i, s in own)
        hits.append(len(best & {i for _, i, _ in own}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_edge_rows(vectors):
    own = {i: v for i, v in usable([(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]).items() if any(v)}
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {i for i in own if i % 20 == 0}
    assert {r.vec_id for r in got} <= set(own)
    assert [(r.vec_id, r.score) for r in got if r.query_id == 500] == [(501, 4.0)]
    # Forty copies of one vector: the smallest ids come first.
    nearest = topk.best(np.array([r.score for r in got if r.query_id == 300]), np.array([r.vec_id for r in got if r.query_id == 300]), 20)
    ranks = [r.rank for r in got if r.query_id == 300]
    assert [ranks[i] for i in nearest] == list(range(1, 21))


def test_no_vectors(vectors):
    none = vectors.limit(0)
    assert topk.nearest(none, F.lit(True)).count() == 0 and ann.nearest(none, F.lit(True)).count() == 0
    assert ann.nearest(vectors, F.lit(False)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    from markbook.llm import common, minhash, mixing, pii

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        seen.append((docs, after))
        docs = after
    labels = common.table(spark, folder, "labels")
    clean = toxicity.scored(seen[0][0], labels).where("predicted = 0").select("doc_id")
    assert set(clean.collect()) == set(seen[0][1].select("doc_id").collect())
    kept = minhash.grouped(seen[1][0], corpus_pipeline.NEAR_COPIES).where("kept").select("doc_id")
    assert sorted(kept.collect()) == sorted(seen[1][1].select("doc_id").collect())
    assert seen[2][0].count() == seen[2][1].count()
    assert pii.found(seen[2][1]).where("spans <> ''").count() == 0
    want = mixing.plan(seen[3][0]).agg(F.sum("copies")).first()[0]
    assert want == seen[3][1].count() == docs.count()
    assert docs.where("NOT exact").count() == 0


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.where("NOT exact").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_on_edge_rows(spark, documents, no_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (documents, no_documents):
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.SQL) <= set(queries.QUERIES)
