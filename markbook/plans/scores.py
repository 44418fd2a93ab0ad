"""Accuracy, votes, resuming and run comparison over graded completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completions as C
from ..operators import metrics as M
from ..operators import voting as V
from ..streaming.incremental import grade_stream, graded_so_far, with_arrival
from ..session import scratch_dir
from .fixtures import COMPLETIONS, GRADED, completions, graded
from .registry import query, table

ROUNDED = "round_even(100 * (CAST(sum(first) AS DOUBLE) / count(*)), 1)"


@query(
    "agg1_accuracy",
    f"""WITH {GRADED},
 qs AS (SELECT idx, count(*) AS n, min_by(CAST(score AS INT), sample_id) AS first,
               max_by(CASE WHEN pred = '' THEN 1 ELSE 0 END, sample_id) AS empty
        FROM graded GROUP BY idx)
 SELECT count(*) AS num_samples, CAST(sum(n) AS BIGINT) AS num_scores,
        CAST(sum(empty) AS BIGINT) AS empty_samples,
        CAST(sum(first) AS DOUBLE) / count(*) AS acc_ratio, {ROUNDED} AS acc FROM qs""",
)
def agg1(spark, folder):
    return M.accuracy(graded(spark, folder))


@query(
    "agg2_position_curve",
    f"""WITH {GRADED},
 qs AS (SELECT idx, count(*) AS n, max_by(CAST(score AS INT), sample_id) AS last FROM graded GROUP BY idx),
 grid AS (SELECT qs.*, unnest(range((SELECT max(n) FROM qs))) AS position FROM qs)
 SELECT position, CAST(sum(coalesce(CAST(g.score AS INT), grid.last)) AS DOUBLE) / count(*) AS mean_score
 FROM grid LEFT JOIN graded g ON g.idx = grid.idx AND g.sample_id = grid.position GROUP BY position""",
)
def agg2(spark, folder):
    return M.position_curve(graded(spark, folder))


TYPE_ACC = f"""WITH {GRADED},
 qs AS (SELECT type, idx, max_by(CAST(score AS INT), sample_id) AS last FROM graded GROUP BY type, idx)
 SELECT type, count(*) AS num_samples, CAST(sum(last) AS DOUBLE) / count(*) AS acc_ratio FROM qs GROUP BY type"""


@query("agg3_type_accuracy", TYPE_ACC)
def agg3(spark, folder):
    return M.type_accuracy(graded(spark, folder)).drop("acc")


@query(
    "agg4_macro_average",
    f"""WITH t AS ({TYPE_ACC})
 SELECT type AS dataset, round(acc_ratio, 9) AS acc FROM t
 UNION ALL SELECT 'avg', round(avg(acc_ratio), 9) FROM t""",
)
def agg4(spark, folder):
    per_type = M.type_accuracy(graded(spark, folder)).select(
        F.col("type").alias("dataset"), F.col("acc_ratio").alias("acc")
    )
    return M.macro_average(per_type).withColumn("acc", F.round("acc", 9))


def _maj(k, key="pred"):
    return f"""WITH {GRADED},
 ballots AS (SELECT idx, {key} AS choice, count(*) AS votes, min(sample_id) AS seen,
                    min_by(score, sample_id) AS score
             FROM graded WHERE sample_id < {k} GROUP BY idx, {key}),
 won AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY votes DESC, seen) AS rn FROM ballots)
 SELECT count(*) AS questions, CAST(sum(CAST(score AS INT)) AS DOUBLE) / count(*) AS maj_at_{k}
 FROM won WHERE rn = 1"""


@query("agg5_maj_at_4", _maj(4))
def agg5(spark, folder):
    return V.maj_at_k(graded(spark, folder), 4)


@query("agg5_maj_at_8", _maj(8))
def agg5_8(spark, folder):
    return V.maj_at_k(graded(spark, folder), 8)


def spelled(df):
    """The same numbers in several spellings, so that text and value votes differ."""
    p, s = F.col("pred"), F.col("sample_id")
    other = F.when(s % 3 == 1, F.concat(p, F.lit(".0"))).when(
        s % 3 == 2, F.concat(F.lit("\\frac{"), p, F.lit("}{1}"))
    ).otherwise(p)
    return df.withColumn("pred", F.when(p != "", other).otherwise(p))


@query(
    "agg6_maj_by_value",
    _maj(8, "CASE WHEN pred = '' THEN '' ELSE CAST(CAST(pred AS DOUBLE) AS VARCHAR) END"),
)
def agg6(spark, folder):
    return V.maj_at_k(spelled(graded(spark, folder)), 8, key="value")


@query(
    "agg6_maj_greedy",
    _maj(4, "CASE WHEN pred = '' THEN '' ELSE CAST(CAST(pred AS DOUBLE) AS VARCHAR) END"),
)
def agg6_greedy(spark, folder):
    return V.maj_at_k(spelled(graded(spark, folder)), 4, key="greedy")


@query("agg6_maj_by_normalized_text", _maj(8, "CASE WHEN pred = '' THEN '' WHEN sample_id % 3 = 2 THEN concat('f', pred) ELSE pred END"))
def agg6_text(spark, folder):
    return V.maj_at_k(spelled(graded(spark, folder)), 8, key="normalized")


@query(
    "agg7_rm_at_4",
    f"""WITH {GRADED},
 best AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pred_score DESC, sample_id) AS rn
          FROM graded WHERE sample_id < 4)
 SELECT count(*) AS questions, CAST(sum(CAST(score AS INT)) AS DOUBLE) / count(*) AS rm_at_4
 FROM best WHERE rn = 1""",
)
def agg7(spark, folder):
    return V.rm_at_k(graded(spark, folder), 4)


@query(
    "agg8_bool_majority",
    f"""WITH {GRADED}
 SELECT idx, CAST(count(*) FILTER (score) AS BIGINT) AS "right", CAST(count(*) FILTER (NOT score) AS BIGINT) AS wrong,
        CASE WHEN count(*) FILTER (score) > count(*) FILTER (NOT score) THEN true
             WHEN count(*) FILTER (score) < count(*) FILTER (NOT score) THEN false
             ELSE min_by(score, sample_id) END AS best_of_n_score
 FROM graded GROUP BY idx""",
)
def agg8(spark, folder):
    return V.bool_majority(graded(spark, folder))


@query(
    "agg9_vote",
    f"""WITH {GRADED},
 b AS (SELECT idx, pred, count(*) AS votes, min(sample_id) AS seen FROM graded GROUP BY idx, pred)
 SELECT idx, pred, votes FROM (
   SELECT *, row_number() OVER (PARTITION BY idx ORDER BY votes DESC, seen) AS rn FROM b) WHERE rn = 1""",
)
def agg9(spark, folder):
    return V.vote(graded(spark, folder).select("idx", "sample_id", "pred"))


@query(
    "cmp3_regroup_samples",
    f"""WITH {GRADED}
 SELECT idx, CAST(count(*) AS INTEGER) AS n, string_agg(pred, '|' ORDER BY sample_id) AS preds,
        string_agg(CAST(score AS VARCHAR), '|' ORDER BY sample_id) AS scores
 FROM graded GROUP BY idx""",
)
def cmp3(spark, folder):
    wide = C.grouped_samples(graded(spark, folder), ("pred", "score"))
    return wide.select(
        "idx", F.size("pred").alias("n"), F.array_join("pred", "|").alias("preds"),
        F.array_join(F.transform("score", lambda s: s.cast("string")), "|").alias("scores"),
    )


@query(
    "jn1_resume_anti",
    "SELECT o_orderkey AS idx, o_orderpriority AS type FROM orders WHERE o_orderstatus <> 'F'",
)
def jn1(spark, folder):
    orders = table(spark, folder, "orders")
    questions = orders.select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("type"))
    done = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("idx"))
    return C.remaining(questions, done)


@query(
    "jn2_attach_results",
    f"""WITH {GRADED}
 SELECT idx, sample_id, gt, pred, score FROM graded""",
)
def jn2(spark, folder):
    samples = completions(spark, folder).select("idx", "sample_id", "gt")
    return C.attach_results(samples, graded(spark, folder).select("idx", "sample_id", "pred", "score"))


@query(
    "agg5_short_questions",
    f"""WITH {GRADED}, n AS (SELECT idx, count(*) AS n FROM graded GROUP BY idx)
 SELECT count(*) AS questions, count(*) FILTER (n < 4) AS short FROM n""",
)
def agg5_short(spark, folder):
    return V.short_questions(graded(spark, folder), 4)


PAIR = f"""WITH {GRADED},
 a AS (SELECT idx, score FROM graded WHERE sample_id = 0),
 b AS (SELECT idx, score FROM graded WHERE sample_id = 1)"""


@query(
    "jn3_regressions",
    f"""WITH {GRADED}
 SELECT idx FROM graded WHERE sample_id < 2 GROUP BY idx
 HAVING bool_or(sample_id = 0 AND score) AND bool_or(sample_id = 1 AND NOT score)""",
)
def jn3(spark, folder):
    g = graded(spark, folder)
    return C.regressions(g.filter("sample_id = 0"), g.filter("sample_id = 1"))


@query(
    "jn3_transitions",
    PAIR + """ SELECT a.score AS score_a, b.score AS score_b, count(*) AS questions
 FROM a JOIN b USING (idx) GROUP BY 1, 2""",
)
def jn3_cells(spark, folder):
    g = graded(spark, folder)
    return C.transitions(g.filter("sample_id = 0"), g.filter("sample_id = 1"))


@query(
    "win1_last_record",
    """SELECT user_id AS idx, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type,
       max_by(value, event_id) AS value FROM events GROUP BY user_id""",
)
def win1(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("idx"), "event_id", "event_type", "value"
    )
    return C.last_record(events, ["idx"], F.col("event_id"))


@query(
    "set2_append_samples",
    f"""WITH {COMPLETIONS}
 SELECT idx, sample_id, CASE WHEN sample_id = 0 THEN type END AS type, gt FROM f1""",
)
def set2(spark, folder):
    f1 = completions(spark, folder)
    processed = f1.filter("sample_id > 0").select("idx", "sample_id", "gt")
    return C.append_new(processed, f1.filter("sample_id = 0").select("idx", "sample_id", "type", "gt"))


@query("grd_distinct_pairs", f"WITH {GRADED} SELECT idx, sample_id, pred, gt, score FROM graded")
def grd_distinct(spark, folder):
    g = C.with_predictions(completions(spark, folder), "math")
    return C.grade_distinct(g).select("idx", "sample_id", "pred", "gt", "score")


@query(
    "grd11_rung_counts",
    f"""WITH {GRADED}
 SELECT CASE WHEN lower(pred) = lower(gt) THEN 'text' WHEN pred = '' THEN 'empty'
             WHEN score THEN 'number' ELSE 'number_differs' END AS rung, count(*) AS scores
 FROM graded GROUP BY 1""",
)
def grd11(spark, folder):
    return graded(spark, folder).groupBy("rung").agg(F.count("*").alias("scores"))


@query(
    "str1_incremental_grading",
    """SELECT o_orderkey AS idx, CAST(0 AS INTEGER) AS sample_id,
       CAST((o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 3 AS VARCHAR) AS pred,
       (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 3 = o_orderkey % 3 AS score FROM orders""",
)
def str1(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    source = scratch_dir(spark, "deliveries")
    # A quarter of the orders is delivered again, changed, in the same batch.
    orders.write.parquet(f"{source}/a")
    again = orders.filter("o_orderkey % 4 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    again.write.parquet(f"{source}/b")
    stream = with_arrival(spark.readStream.schema(orders.schema).option("recursiveFileLookup", True).parquet(source))
    key, v = F.col("o_orderkey"), (F.col("o_custkey") % 3).cast("string")
    samples = stream.select(
        key.alias("idx"), F.lit(0).alias("sample_id"), (key % 3).cast("string").alias("gt"),
        F.concat(F.lit("So the total is \\boxed{"), v, F.lit("}.")).alias("code"), "arrived",
    )
    home = scratch_dir(spark, "incremental")
    grade_stream(samples, C.grade_completions, f"{home}/graded", f"{home}/checkpoint")
    return graded_so_far(spark, f"{home}/graded").select("idx", "sample_id", "pred", "score")


def _wide(spark, folder):
    """Stored results: one row per question; every third question twice, the first time without its lists."""
    done = C.with_predictions(completions(spark, folder), "math")
    gold = done.groupBy("idx").agg(F.max("type").alias("type"), F.concat(F.lit("so it is #### "), F.max("gt")).alias("answer"))
    lists = C.grouped_samples(done, ("code", "pred")).join(gold, "idx")
    rewards = F.transform("pred", lambda p, i: F.array((i % 3).cast("double")))
    loads = F.when(F.col("idx") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    wide = lists.withColumn("pred_score", rewards).withColumn("loaded", F.explode(loads))
    return wide.withColumn("pred", F.when(F.col("loaded") == 1, F.col("pred")).otherwise(F.array().cast("array<string>")))


@query("eval_wide_samples", f"WITH {GRADED} SELECT idx, sample_id, gt, pred, score, CAST(sample_id % 3 AS DOUBLE) AS reward FROM graded")
def eval_wide(spark, folder):
    done = C.evaluate(_wide(spark, folder), "gsm8k", F.col("loaded"))
    return done.select("idx", "sample_id", "gt", "pred", "score", F.col("pred_score").alias("reward"))


@query(
    "eval_metrics_record",
    f"""WITH {GRADED},
 qs AS (SELECT idx, count(*) AS n, min_by(CAST(score AS INT), sample_id) AS first,
               max_by(CASE WHEN pred = '' THEN 1 ELSE 0 END, sample_id) AS empty
        FROM graded GROUP BY idx)
 SELECT count(*) AS num_samples, CAST(sum(n) AS BIGINT) AS num_scores, 0::BIGINT AS timeout_samples,
        CAST(sum(empty) AS BIGINT) AS empty_samples, {ROUNDED} AS acc,
        CAST(125.5 AS DOUBLE) AS time_use_in_second, '2:05' AS time_use_in_minite FROM qs""",
)
def eval_record(spark, folder):
    done = C.evaluate(_wide(spark, folder), "gsm8k", F.col("loaded"))
    return M.metrics_record(done, 125.5).drop("acc_ratio", "type_acc")


@query(
    "eval_rewards",
    f"""WITH {GRADED},
 best AS (SELECT idx, arg_max(score, (sample_id % 3) * 100 - sample_id) AS score FROM graded WHERE sample_id < 4 GROUP BY idx)
 SELECT count(*) AS questions, CAST(sum(CAST(score AS INT)) AS DOUBLE) / count(*) AS rm_at_4 FROM best""",
)
def eval_rewards(spark, folder):
    return V.rm_at_k(C.evaluate(_wide(spark, folder), "gsm8k", F.col("loaded")), 4)
