import random

import pytest
from pyspark.sql import functions as F

from markbook.functions.vectors import fake_quantize, group_params, mask_all_but_last, mean_negative_logprob
from markbook.operators import windows as W


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    docs = [(i * 3, " ".join(f"w{draw.randint(0, 99)}" for _ in range(3000 if i == 5 else draw.randint(1, 60)))) for i in range(80)]
    whole = [w for _, text in docs for w in text.split(" ")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), docs, whole


def words():
    return W.words(F.col("text"))


def test_consecutive(corpus):
    df, _, whole = corpus
    got = {r["window"]: r["tokens"] for r in W.consecutive_windows(df, "doc_id", words(), 64).collect()}
    assert got == {i: whole[i * 64:(i + 1) * 64] for i in range(len(whole) // 64)}


@pytest.mark.parametrize("length", [7, 64, 500])
def test_sampled(corpus, length):
    df, _, whole = corpus
    starts = W.window_starts(len(whole), 30, length, seed=4)
    got = {r["window"]: r["tokens"] for r in W.sample_windows(df, "doc_id", words(), 30, length, 4).collect()}
    assert got == {i: whole[s:s + length] for i, s in enumerate(starts)}


def test_sampled_needs_enough_tokens(corpus):
    df, _, whole = corpus
    with pytest.raises(ValueError):
        W.sample_windows(df, "doc_id", words(), 3, len(whole), 0)


def test_head(corpus):
    df, docs, _ = corpus
    rows = W.corpus_head(df, "doc_id", words(), 10, 200).orderBy("start").collect()
    flat = [w for _, text in docs[:10] for w in text.split(" ")][:200]
    assert [w for r in rows for w in r["tokens"]] == flat


def test_crops(corpus):
    df, docs, _ = corpus
    texts = {k: t.split(" ") for k, t in docs}
    rows = W.crop_documents(df, "doc_id", words(), 8, 20, F.xxhash64("doc_id", F.lit(1))).collect()
    assert len(rows) == 8
    for r in rows:
        text = texts[r["doc_id"]]
        assert any(text[i:i + 20] == r["tokens"] for i in range(len(text) - 19))


def test_mask(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "t array<int>")
    assert df.select(mask_all_but_last(F.col("t"))).first()[0] == [-100, -100, 7]


def test_nll(spark):
    df = spark.createDataFrame([([-9.0, -1.0, -3.0], 1), ([-9.0], 1)], "lp array<double>, n int")
    assert [r[0] for r in df.select(mean_negative_logprob(F.col("lp"), F.col("n"))).collect()] == [2.0, None]


@pytest.mark.parametrize("sym", [False, True])
def test_quantize_by_hand(spark, sym):
    values = [0.5, -1.0, 0.25, 2.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(values,)], "v array<float>")
    params = df.select(group_params(F.col("v"), 2, 4, sym)).first()[0]
    lo, hi = (-2.0, 2.0) if sym else (-1.0, 2.0)
    scale = (hi - lo) / 3
    zero = 2.0 if sym else float(round(-lo / scale))
    assert [(p["scale"], p["zero"]) for p in params][0] == pytest.approx((scale, zero))
    assert (params[1]["lo"], params[1]["hi"]) == (-1.0, 1.0)
    got = df.select(fake_quantize(F.col("v"), 2, 4, sym)).first()[0]
    want = [scale * (min(max(round(x / scale) + zero, 0), 3) - zero) for x in values[:4]]
    assert got[:4] == pytest.approx(want)
    if not sym:
        assert max(abs(a - b) for a, b in zip(values, got)) <= scale / 2 + 1e-9
