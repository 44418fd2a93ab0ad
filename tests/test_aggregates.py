"""Votes, curves and ranks against plain Python, with one question that holds most samples."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from markbook.operators import completions as C
from markbook.operators import cost, metrics, ordering, sweep, voting


@pytest.fixture(scope="module")
def samples(spark):
    draw = random.Random(3)
    rows = []
    for idx in range(40):
        for s in range(400 if idx == 7 else draw.randint(1, 9)):
            pred = draw.choice(["1", "2", "3", ""])
            rows.append((idx, s, f"t{idx % 3}", pred, pred == "1", draw.randint(0, 5) / 5))
    df = spark.createDataFrame(rows, "idx long, sample_id int, type string, pred string, score boolean, pred_score double")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return df.repartition(4), groups


def test_accuracy(samples):
    df, groups = samples
    row = metrics.accuracy(df).first()
    assert row["num_samples"] == len(groups) and row["num_scores"] == sum(map(len, groups.values()))
    assert row["acc_ratio"] == pytest.approx(sum(g[0][4] for g in groups.values()) / len(groups))
    assert row["empty_samples"] == sum(g[-1][3] == "" for g in groups.values())
    by_type = {r["type"]: r["acc_ratio"] for r in metrics.type_accuracy(df).collect()}
    for t, share in by_type.items():
        last = [g[-1][4] for g in groups.values() if g[0][2] == t]
        assert share == pytest.approx(sum(last) / len(last))


@pytest.mark.parametrize("span", [3, 4096])
def test_position_curve(samples, span):
    df, groups = samples
    longest = max(map(len, groups.values()))
    padded = [[r[4] for r in g] + [g[-1][4]] * (longest - len(g)) for g in groups.values()]
    want = [sum(col) / len(padded) for col in zip(*padded)]
    got = {r["position"]: r["mean_score"] for r in metrics.position_curve(df, span).collect()}
    assert sorted(got) == list(range(longest))
    assert [got[i] for i in range(longest)] == pytest.approx(want)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_votes(samples, k):
    df, groups = samples
    right = best = 0
    for g in groups.values():
        first = g[:k]
        top = Counter(r[3] for r in first).most_common(1)[0][0]
        right += next(r[4] for r in first if r[3] == top)
        best += max(first, key=lambda r: r[5])[4]
    assert voting.maj_at_k(df, k).first()[f"maj_at_{k}"] == pytest.approx(right / len(groups))
    assert voting.rm_at_k(df, k).first()[f"rm_at_{k}"] == pytest.approx(best / len(groups))


def test_vote_by_value(spark):
    rows = [(1, 0, "2", False), (1, 1, "0.5", True), (1, 2, "\\frac{1}{2}", True), (1, 3, "2.0", False), (1, 4, "50%", True)]
    df = spark.createDataFrame(rows, "idx long, sample_id int, pred string, score boolean")
    assert voting.maj_at_k(df, 5).first()["maj_at_5"] == 0.0
    assert voting.maj_at_k(df, 5, key="value").first()["maj_at_5"] == 1.0


def test_greedy_vote_depends_on_the_order(spark):
    """100 and 100.018 are apart, 100.009 is equal to both: who comes first decides."""
    rows = [(1, i, x) for i, x in enumerate(["100", "100.009", "100.018", "100.018"])]
    rows += [(2, i, x) for i, x in enumerate(["100.009", "7", "100", "7", "100.018"])]
    rows += [(3, i, x) for i, x in enumerate([r"\frac{1}{2}", "3", "0.5", "3"])]
    rows += [(4, 0, None), (4, 1, ""), (4, 2, None), (None, 0, "9")]
    df = spark.createDataFrame(rows, "idx long, sample_id int, pred string").repartition(3)
    got = {r["idx"]: (r["pred"], r["votes"]) for r in voting.greedy_vote(df).collect()}
    assert got == {1: ("100", 2), 2: ("100.009", 3), 3: (r"\frac{1}{2}", 2), 4: (None, 2), None: ("9", 1)}
    assert voting.greedy_vote(df.where("false")).collect() == []


def test_bool_majority_tie(spark):
    rows = [(1, 0, True), (1, 1, False), (2, 0, False), (2, 1, True), (3, 0, False)]
    df = spark.createDataFrame(rows, "idx long, sample_id int, score boolean")
    assert {r["idx"]: r["best_of_n_score"] for r in voting.bool_majority(df).collect()} == {1: True, 2: False, 3: False}


def test_wide_rows_are_bounded(samples):
    df, groups = samples
    wide = C.grouped_samples(df, ("pred", "score"), chunk=50).orderBy("idx", "part").collect()
    assert max(len(r["pred"]) for r in wide) <= 50
    assert [p for r in wide if r["idx"] == 7 for p in r["pred"]] == [r[3] for r in groups[7]]


def test_last_record_twice_is_once(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "idx long, v string, at long")
    once = C.last_record(df, ["idx"], F.col("at"))
    assert sorted(map(tuple, once.collect())) == [(1, "b", 2), (2, "c", 1)]
    assert sorted(map(tuple, C.last_record(once, ["idx"], F.col("at")).collect())) == [(1, "b", 2), (2, "c", 1)]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.3325,), (0.3335,)], "r double")
    assert [r[0] for r in df.select(metrics.rounded_percent(F.col("r"))).collect()] == [33.2, 33.4]


def test_type_map(samples):
    df, _ = samples
    record = metrics.metrics_record(df).first()
    assert list(record["type_acc"]) == ["t0", "t1", "t2"] and record["timeout_samples"] == 0


def hot_values(spark):
    draw = random.Random(5)
    rows = [(i, 1.0 if i % 3 == 0 else draw.randint(0, 30) / 7, draw.randint(0, 4) / 4, f"s{i % 2}") for i in range(2000)]
    return rows, spark.createDataFrame(rows, "k long, cost double, accuracy double, series string").repartition(4)


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 10)
    import numpy as np

    rows, df = hot_values(spark)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    names = [f"q{i}" for i in range(len(shares))]
    whole = ordering.exact_quantiles(df, "cost", shares, names).first()
    assert [whole[n] for n in names] == pytest.approx(list(np.quantile([r[1] for r in rows], shares)))
    for r in ordering.exact_quantiles(df, "cost", shares, names, ["series"]).collect():
        want = np.quantile([x[1] for x in rows if x[3] == r["series"]], shares)
        assert [r[n] for n in names] == pytest.approx(list(want))


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_rank_brackets_only(spark, monkeypatch, accuracy):
    """Distinct values, a hot one, negative ones, a tiny group, nulls; a coarse sketch and a fine one."""
    import numpy as np

    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    kept = []
    monkeypatch.setattr(ordering, "settle", lambda df, settle=ordering.settle: kept.append(settle(df)) or kept[-1])
    draw = random.Random(8)
    rows = [("big", draw.gauss(0, 10)) for _ in range(12_000)] + [("big", 2.5)] * 6_000
    rows += [("tiny", float(x)) for x in range(3)] + [("one", 4.0), ("tiny", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares, names = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0), ("a", "b", "c", "d", "e", "f")
    got = {r["g"]: [r[n] for n in names] for r in ordering.exact_quantiles(df, "x", shares, names, ["g"]).collect()}
    assert set(got) == {"big", "tiny", "one"}
    for g, found in got.items():
        assert found == pytest.approx(list(np.quantile([x for h, x in rows if h == g and x is not None], shares)))
    whole = ordering.exact_quantiles(df, "x", shares, names).first()
    assert list(whole) == pytest.approx(list(np.quantile([x for _, x in rows if x is not None], shares)))
    if accuracy == 10_000:
        assert kept[-1].count() < 600
    assert list(ordering.exact_quantiles(df.where("false"), "x", (0.5,), ("m",)).first()) == [None]


def test_cost_curve_with_a_hot_cost(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 100)
    rows, df = hot_values(spark)
    got = {r["k"]: (r["prev_cost"], r["prev_value"]) for r in cost.cost_curve(df, "series", tie="k").collect()}
    for series in ("s0", "s1"):
        points = sorted((r[1], r[2], r[0]) for r in rows if r[3] == series)
        before = [(None, None)] + [(c, a) for c, a, _ in points]
        for (_, _, k), prev in zip(points, before):
            assert got[k] == prev
    ranges = df.select(*ordering.order_buckets(df, ["cost", "accuracy", "k"], 16)).groupBy("_b0", "_b1", "_b2").count()
    assert ranges.agg(F.max("count")).first()[0] < 400  # the hot cost has 667+ rows


def test_index_and_sums(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 50)
    keys = random.Random(1).sample(range(10**6), 1000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "key long, w int").repartition(4)
    got = {r["key"]: r["idx"] for r in ordering.with_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    sums, total = {}, 0
    for k in sorted(keys):
        sums[k], total = total, total + k % 7
    assert {r["key"]: r["s"] for r in ordering.running_sum(df, "key", F.col("w"), "s").collect()} == sums
    window = ordering.take_slice(df, "key", head=100, start=10, end=50)
    assert sorted(r["key"] for r in window.collect()) == sorted(keys)[10:50]
    assert ordering.with_index(df.withColumn("idx", F.lit(1)), "key").columns == ["key", "w", "idx"]


def test_shuffle_repeats(spark):
    df = spark.range(200)
    one = [r[0] for r in ordering.shuffled(df, "id", 3).collect()]
    assert one == [r[0] for r in ordering.shuffled(df.repartition(4), "id", 3).collect()]
    assert one != sorted(one) and sorted(one) == list(range(200))


def test_grid(spark):
    grid = sweep.sweep_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("task_id").collect()
    assert [(r["a"], r["b"]) for r in grid] == [(a, b) for a in (1, 2) for b in "xyz"]
    with pytest.raises(ValueError):
        sweep.sweep_grid(spark, {"a": []})


def test_latency_leaves_warm_up_out(spark):
    df = spark.createDataFrame([("m", i, 100.0 if i == 0 else float(i)) for i in range(6)], "s string, run_no int, seconds double")
    assert cost.mean_latency(df, ["s"]).first()["avg_latency"] == 3.0


def test_metrics_record_reads_its_samples_once(spark):
    rows = [
        ("a", 1, 0, "1", True), ("a", 1, 1, "", False), ("b", 1, 2, "3", True), ("b", 2, 0, "", False),
        (None, 3, 0, None, True), ("a", 3, 1, "7", True), ("b", None, 0, "2", True),
    ]
    df = spark.createDataFrame(rows, "type string, idx long, sample_id int, pred string, score boolean")
    record = metrics.metrics_record(df)
    assert record._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = record.drop("type_acc").first().asDict()
    want = metrics.accuracy(df).first().asDict()
    assert {k: got[k] for k in want} == want
    typed = metrics.metrics_record(df.filter("type is not null")).first()
    assert typed.type_acc == {r.type: r.acc for r in metrics.type_accuracy(df.filter("type is not null")).collect()}
    empty = metrics.metrics_record(df.limit(0)).first()
    assert (empty.num_samples, empty.num_scores, empty.acc, empty.type_acc) == (0, None, None, {})
