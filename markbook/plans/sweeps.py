"""Sweep tables, costs, likelihood, latency and array arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as A
from ..operators import cost as K
from ..operators import sweep as W
from ..operators.prompts import token_count
from .fixtures import GRADED, LOGPROBS, RUNS, completions, graded, logprobs, parsed_runs, runs
from .registry import query, table

R = f"WITH {RUNS}"


@query("txt1_metric_file_name", R + """ SELECT run_no, top_k, is_thinking_mode AS enable_thinking FROM runs WHERE checkpoint <> 300""")
def txt1(spark, folder):
    df = parsed_runs(spark, folder)
    flag = F.when(F.col("is_thinking_mode"), "True").otherwise("False")
    tail = F.when(F.col("checkpoint") == 300, "_metrics.txt").otherwise("_metrics.json")
    name = F.concat(
        F.lit("test_qwen25-math-cot_-1_seed0_t0.0_top_k"), F.col("top_k").cast("string"),
        F.lit("_enable_thinking"), flag, F.lit("_s0_e-1_qwen25-math-cot"), tail,
    )
    parsed = df.select("run_no", W.parse_metric_file(name).alias("f")).filter("f IS NOT NULL")
    return parsed.select("run_no", "f.top_k", "f.enable_thinking")


@query("txt2_run_path", R + " SELECT run_no, checkpoint, max_tokens_per_call, is_thinking_mode FROM runs")
def txt2(spark, folder):
    return runs(spark, folder).select("run_no", W.parse_run_path(F.col("file_path")).alias("r")).select("run_no", "r.*")


def _stats(by):
    return R + f""" SELECT {by}, round(avg(accuracy), 2) AS mean, round(stddev_samp(accuracy), 2) AS std, count(*) AS count
 FROM runs GROUP BY {by}"""


@query("agg13_stats_by_checkpoint", _stats("checkpoint"))
def agg13(spark, folder):
    return W.grouped_stats(parsed_runs(spark, folder), "checkpoint")


@query("agg13_stats_by_each", R + """ SELECT CASE WHEN grouping(checkpoint) = 0 THEN 'checkpoint' WHEN grouping(top_k) = 0 THEN 'top_k'
   ELSE 'max_tokens_per_call' END AS setting, CAST(coalesce(checkpoint, top_k, max_tokens_per_call) AS VARCHAR) AS level,
   round(avg(accuracy), 2) AS mean, round(stddev_samp(accuracy), 2) AS std, count(*) AS count
 FROM runs GROUP BY GROUPING SETS ((checkpoint), (top_k), (max_tokens_per_call))""")
def agg13_sets(spark, folder):
    return W.stats_by_each(parsed_runs(spark, folder), ["checkpoint", "top_k", "max_tokens_per_call"])


TOP_K = [1, 2, 3, 4, 5, 6]
PIVOT = ", ".join(f"round(avg(accuracy) FILTER (top_k = {k}), 6) AS top_k_{k}" for k in TOP_K)


def _pivot(spark, folder, index):
    df = W.pivot_mean(parsed_runs(spark, folder), index, "top_k", TOP_K)
    return df.select(*index, *[F.round(f"top_k_{k}", 6).alias(f"top_k_{k}") for k in TOP_K])


@query("agg14_pivot", R + f" SELECT checkpoint, {PIVOT} FROM runs GROUP BY checkpoint")
def agg14(spark, folder):
    return _pivot(spark, folder, ["checkpoint"])


@query("agg14_pivot_two_keys", R + f" SELECT checkpoint, max_tokens_per_call, {PIVOT} FROM runs GROUP BY 1, 2")
def agg14_two(spark, folder):
    return _pivot(spark, folder, ["checkpoint", "max_tokens_per_call"])


@query("agg15_describe", R + """ SELECT count(*) AS count, round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std,
  min(accuracy) AS min, round(quantile_cont(accuracy, 0.25), 9) AS p25, round(quantile_cont(accuracy, 0.5), 9) AS p50,
  round(quantile_cont(accuracy, 0.75), 9) AS p75, max(accuracy) AS max FROM runs""")
def agg15(spark, folder):
    df = W.describe(parsed_runs(spark, folder))
    exact = ("count", "min", "max")
    return df.select(*[c if c in exact else F.round(c, 9).alias(c) for c in df.columns])


@query("agg16_null_counts", R + """, x AS (SELECT CASE WHEN top_k <> 3 THEN checkpoint END AS checkpoint, top_k,
   CASE WHEN is_thinking_mode THEN accuracy END AS accuracy FROM runs)
 SELECT 'checkpoint' AS "column", count(*) - count(checkpoint) AS nulls FROM x UNION ALL
 SELECT 'top_k', count(*) - count(top_k) FROM x UNION ALL SELECT 'accuracy', count(*) - count(accuracy) FROM x""")
def agg16(spark, folder):
    df = parsed_runs(spark, folder).select(
        F.when(F.col("top_k") != 3, F.col("checkpoint")).alias("checkpoint"), "top_k",
        F.when(F.col("is_thinking_mode"), F.col("accuracy")).alias("accuracy"),
    )
    return W.null_counts(df)


@query("agg16_flag_counts", R + " SELECT count(*) FILTER (is_thinking_mode) AS true_count, count(*) FILTER (NOT is_thinking_mode) AS false_count FROM runs")
def agg16_flags(spark, folder):
    return W.flag_counts(parsed_runs(spark, folder), "is_thinking_mode")


@query("agg17_hours", R + """ SELECT round(avg(time_seconds / 3600), 9) AS mean_hours, round(median(time_seconds / 3600), 9) AS median_hours,
  round(min(time_seconds / 3600), 9) AS min_hours, round(max(time_seconds / 3600), 9) AS max_hours FROM runs""")
def agg17(spark, folder):
    df = W.hour_stats(parsed_runs(spark, folder))
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("agg18_five_numbers", R + """ SELECT checkpoint, min(accuracy) AS low, round(quantile_cont(accuracy, 0.25), 9) AS q1,
  round(quantile_cont(accuracy, 0.5), 9) AS median, round(quantile_cont(accuracy, 0.75), 9) AS q3, max(accuracy) AS high
 FROM runs GROUP BY checkpoint""")
def agg18(spark, folder):
    df = W.five_numbers(parsed_runs(spark, folder), "checkpoint")
    return df.select("checkpoint", "low", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "high")


@query("agg19_best_row", R + """ SELECT checkpoint, top_k, max_tokens_per_call, accuracy FROM runs
 ORDER BY accuracy DESC, run_no LIMIT 1""")
def agg19(spark, folder):
    return W.best_row(parsed_runs(spark, folder), "accuracy", ["checkpoint", "top_k", "max_tokens_per_call"], "run_no")


COLUMNS = ["checkpoint", "top_k", "max_tokens_per_call", "accuracy", "time_seconds"]


@query("srt3_top_10", R + f" SELECT {', '.join(COLUMNS)} FROM runs ORDER BY accuracy DESC, run_no LIMIT 10")
def srt3_top(spark, folder):
    return W.top_rows(parsed_runs(spark, folder), "accuracy", 10, COLUMNS, "run_no")


@query("srt3_bottom_10", R + f" SELECT {', '.join(COLUMNS)} FROM runs ORDER BY accuracy, run_no LIMIT 10")
def srt3_bottom(spark, folder):
    return W.top_rows(parsed_runs(spark, folder), "accuracy", 10, COLUMNS, "run_no", lowest=True)


@query("srt4_setting_table", R + " SELECT checkpoint, max_tokens_per_call, top_k, accuracy FROM runs ORDER BY 1, 2, 3")
def srt4(spark, folder):
    return W.setting_table(parsed_runs(spark, folder))


@query("flt6_above_quantile", R + """ SELECT run_no, accuracy, time_seconds FROM runs
 WHERE accuracy > (SELECT quantile_cont(accuracy, 0.9) FROM runs) OR time_seconds > (SELECT quantile_cont(time_seconds, 0.9) FROM runs)""")
def flt6(spark, folder):
    df = parsed_runs(spark, folder).select("run_no", "accuracy", "time_seconds")
    return W.above_quantile(df, ["accuracy", "time_seconds"], 0.9)


@query("snk6_summary", R + """ SELECT count(*) AS total_experiments, max(accuracy) AS best_accuracy, min(accuracy) AS worst_accuracy,
  round(avg(accuracy), 6) AS average_accuracy, string_agg(DISTINCT CAST(checkpoint AS VARCHAR), ',' ORDER BY CAST(checkpoint AS VARCHAR)) AS checkpoints,
  string_agg(DISTINCT CAST(top_k AS VARCHAR), ',' ORDER BY CAST(top_k AS VARCHAR)) AS top_k_values,
  '4096,32000' AS max_tokens_values FROM runs""")
def snk6(spark, folder):
    df = W.summary(parsed_runs(spark, folder)).withColumn("average_accuracy", F.round("average_accuracy", 6))
    for name in ("checkpoints", "top_k_values", "max_tokens_values"):
        df = df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return df


# ---------------------------------------------------------------- grids
GRID = {"top_k": [1, 2, 3, 4, 5, 6, 7], "checkpoint": [100, 200, 300, 400, 500, 600], "max_tokens_per_call": [4096, 32000]}


@query("jn6_sweep_grid", """SELECT o_orderkey AS task_id, o_orderkey // 12 % 7 + 1 AS top_k, (o_orderkey // 2 % 6 + 1) * 100 AS checkpoint,
  CASE o_orderkey % 2 WHEN 0 THEN 4096 ELSE 32000 END::BIGINT AS max_tokens_per_call FROM orders""")
def jn6(spark, folder):
    tasks = table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"))
    df = W.decode_tasks(tasks, GRID)
    return df.select("task_id", *[F.col(c).cast("long").alias(c) for c in GRID])


@query("jn7_missing_runs", R + """, grid AS (SELECT t AS top_k, c * 100 AS checkpoint, m AS max_tokens_per_call
   FROM range(1, 8) a(t), range(1, 7) b(c), (VALUES (4096), (32000)) v(m))
 SELECT grid.* FROM grid ANTI JOIN runs USING (top_k, checkpoint, max_tokens_per_call)""")
def jn7(spark, folder):
    grid = W.sweep_grid(spark, GRID).select(*[F.col(c).cast("long").alias(c) for c in GRID])
    done = parsed_runs(spark, folder)
    missing = W.missing_runs(grid, done, list(GRID))
    return missing.withColumn("max_tokens_per_call", F.col("max_tokens_per_call").cast("int"))


# ---------------------------------------------------------------- likelihood
@query("agg10_question_nll", f"WITH {LOGPROBS} SELECT idx, round(nll, 9) AS nll FROM nll")
def agg10(spark, folder):
    return K.question_nll(logprobs(spark, folder)).select("idx", F.round("nll", 9).alias("nll"))


@query("agg10_mean_nll", f"WITH {LOGPROBS} SELECT label, round(avg(nll), 9) AS mean_nll FROM nll GROUP BY label")
def agg10_mean(spark, folder):
    return K.mean_nll(logprobs(spark, folder), ["label"]).withColumn("mean_nll", F.round("mean_nll", 9))


@query("agg11_perplexity", f"""WITH {LOGPROBS} SELECT label, round(exp(sum(nll * (len(lp) - prompt_len)) / sum(len(lp) - prompt_len)), 9) AS perplexity
 FROM nll GROUP BY label""")
def agg11(spark, folder):
    df = K.question_nll(logprobs(spark, folder))
    tokens = F.size("lp") - F.col("prompt_len")
    return K.perplexity(df, F.col("nll") * tokens, tokens, ["label"]).withColumn("perplexity", F.round("perplexity", 9))


@query("agg12_nll_spread", f"""WITH {LOGPROBS}, m AS (SELECT label, avg(nll) AS mean_nll FROM nll GROUP BY label)
 SELECT count(*) AS files, round(avg(mean_nll), 9) AS mean, round(stddev_pop(mean_nll), 9) AS std FROM m""")
def agg12(spark, folder):
    df = K.nll_spread(K.mean_nll(logprobs(spark, folder), ["label"]))
    return df.select("files", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("srt2_nll_by_setting", f"WITH {LOGPROBS} SELECT label, round(avg(nll), 9) AS mean_nll FROM nll GROUP BY label ORDER BY label")
def srt2(spark, folder):
    return agg10_mean(spark, folder).orderBy("label")


# ---------------------------------------------------------------- latency and tokens
@query("agg20_latency", """SELECT l_suppkey AS setting, round(avg(l_extendedprice), 6) AS avg_latency, count(*) AS timed_runs
 FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_suppkey""")
def agg20(spark, folder):
    timings = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("setting"), (F.col("l_linenumber") - 1).alias("run_no"),
        F.col("l_extendedprice").alias("seconds"),
    )
    return K.mean_latency(timings, ["setting"]).withColumn("avg_latency", F.round("avg_latency", 6))


@query("agg22_token_counts", r"SELECT doc_id, CAST(len(string_split_regex(trim(text, E' \n'), '\s+')) AS INTEGER) AS tokens FROM documents")
def agg22(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", token_count(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- cost
MODELS = [("small", 28, 1536, 8960, 2, 12), ("large", 48, 2048, 6144, 4, 32)]
MODEL_COLUMNS = "model string, num_layers int, hidden_dim int, intermediate_dim int, num_kv_heads int, num_heads int"
COST_ROWS = f"""{GRADED},
 models(model, num_layers, hidden_dim, intermediate_dim, num_kv_heads, num_heads) AS (VALUES {", ".join(str(m) for m in MODELS)}),
 tok AS (SELECT type AS run_id, idx, CASE WHEN idx % 2 = 0 THEN 'small' ELSE 'large' END AS model, length(type) AS input_tokens,
    CAST(length(code) AS DOUBLE) AS n, CAST([4, 8, 16][idx % 3 + 1] AS DOUBLE) AS wbits, CAST([16, 8, 4][idx % 3 + 1] AS DOUBLE) AS abits FROM graded),
 per AS (SELECT run_id, idx, model, wbits, abits, max(input_tokens) AS input_tokens, max(n) AS longest, sum(n * (n + 1) / 2) AS grown
    FROM tok GROUP BY ALL),
 c AS (SELECT *, CASE WHEN wbits = 16 THEN 2 ELSE ((128 * wbits + 32) / 128) / 8 END AS wb,
              CASE WHEN abits = 16 THEN 2 ELSE ((128 * abits + 32) / 128) / 8 END AS ab FROM per JOIN models USING (model)),
 cost AS (SELECT run_id, idx, model,
    (longest + 1) * num_layers * (4 * CAST(hidden_dim AS DOUBLE) * hidden_dim + 3 * CAST(hidden_dim AS DOUBLE) * intermediate_dim) * wb AS weight_ops,
    2 * num_layers * (hidden_dim // num_heads) * num_kv_heads * ab * (grown + longest * input_tokens) AS kv_ops FROM c)"""


def cost_samples(df, *carried):
    """Token counts by characters, so that outputs differ in length."""
    third = (F.col("idx") % 3).cast("int")
    return df.select(
        F.col("type").alias("run_id"), "idx", "sample_id",
        F.when(F.col("idx") % 2 == 0, "small").otherwise("large").alias("model"),
        F.length("type").alias("input_tokens"), F.length("code").alias("output_tokens"),
        F.get(F.array(F.lit(4), F.lit(8), F.lit(16)), third).alias("wbits"),
        F.get(F.array(F.lit(16), F.lit(8), F.lit(4)), third).alias("abits"),
        F.lit(128).alias("groupsize"), *carried,
    )


def costs(spark, folder):
    models = spark.createDataFrame(MODELS, MODEL_COLUMNS)
    return K.question_cost(cost_samples(completions(spark, folder)), models)


@query("jn5_model_config", "SELECT run_no, CASE WHEN run_no % 2 = 0 THEN 'small' ELSE 'large' END AS model, CASE WHEN run_no % 2 = 0 THEN 28 ELSE 48 END AS num_layers FROM (SELECT o_orderkey AS run_no FROM orders)")
def jn5(spark, folder):
    df = runs(spark, folder).select("run_no", F.when(F.col("run_no") % 2 == 0, "small").otherwise("large").alias("model"))
    return df.join(F.broadcast(spark.createDataFrame(MODELS, MODEL_COLUMNS)), "model").select("run_no", "model", "num_layers")


@query("arr3_bytes_per_value", "SELECT o_orderkey, CASE b WHEN 16 THEN 2 ELSE (b + 0.25::DOUBLE) / 8 END AS bytes FROM (SELECT o_orderkey, [2, 3, 4, 8, 16][o_orderkey % 5 + 1] AS b FROM orders)")
def arr3(spark, folder):
    bits = F.get(F.array(*[F.lit(b) for b in (2, 3, 4, 8, 16)]), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", A.bytes_per_value(bits, 128).alias("bytes"))


@query("arr4_question_cost", f"WITH {COST_ROWS} SELECT run_id, idx, model, round(weight_ops, 2) AS weight_ops, round(kv_ops, 2) AS kv_ops FROM cost")
def arr4(spark, folder):
    return costs(spark, folder).select("run_id", "idx", "model", F.round("weight_ops", 2).alias("weight_ops"), F.round("kv_ops", 2).alias("kv_ops"))


@query("arr4_cost_of_array", """SELECT vec_id, round((mx + 1) * 28 * (4 * 1536::DOUBLE * 1536 + 3 * 1536::DOUBLE * 8960) * 2
  + 2 * 28 * 128 * 2 * 2 * (grown + mx * label), 2) AS cost
 FROM (SELECT vec_id, label, list_max(n) AS mx, list_sum(list_transform(n, lambda x: x::DOUBLE * (x + 1) / 2)) AS grown
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 1000) AS BIGINT)) AS n FROM embeddings))""")
def arr4_array(spark, folder):
    model = dict(zip(["num_layers", "hidden_dim", "intermediate_dim", "num_kv_heads", "num_heads"], MODELS[0][1:]))
    n = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    df = table(spark, folder, "embeddings").select("vec_id", "label", n.alias("n"))
    cost = A.memory_cost(F.col("label"), F.col("n"), F.lit(16), F.lit(16), 128, model)
    return df.select("vec_id", F.round(cost["cost"], 2).alias("cost"))


@query("agg21_cost_rollup", f"""WITH {COST_ROWS}, v AS (SELECT type AS run_id, idx, CASE WHEN count(*) FILTER (score) > count(*) FILTER (NOT score) THEN 1
   WHEN count(*) FILTER (score) < count(*) FILTER (NOT score) THEN 0 ELSE min_by(CAST(score AS INT), sample_id) END AS s FROM graded GROUP BY ALL)
 SELECT run_id, avg(s) AS average_score, round(sum(weight_ops) / 1e9, 3) AS weight_gops, round(sum(kv_ops) / 1e9, 3) AS kv_gops,
   round(max(weight_ops + kv_ops) / 1e9, 3) AS max_gops FROM cost JOIN v USING (run_id, idx) GROUP BY run_id""")
def agg21(spark, folder):
    models = spark.createDataFrame(MODELS, MODEL_COLUMNS)
    samples = cost_samples(graded(spark, folder), "score")
    df = K.cost_rollup(K.question_cost(samples, models, votes=True))
    giga = {"weight_gops": "weight_ops", "kv_gops": "kv_ops", "max_gops": "max_cost"}
    return df.select("run_id", "average_score", *[F.round(F.col(c) / 1e9, 3).alias(n) for n, c in giga.items()])


@query("win2_normalized_cost", "SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS normalized_cost FROM orders")
def win2(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("cost"))
    return K.normalized_cost(df).select("o_orderkey", "normalized_cost")


@query("win3_cost_curve", R + """ SELECT run_no, top_k, lag(time_seconds) OVER w AS prev_cost, lag(accuracy) OVER w AS prev_value,
   (accuracy - lag(accuracy) OVER w) / nullif(time_seconds - lag(time_seconds) OVER w, 0) AS slope
 FROM runs WINDOW w AS (PARTITION BY top_k ORDER BY time_seconds, accuracy, run_no)""")
def win3(spark, folder):
    df = parsed_runs(spark, folder).select("run_no", "top_k", F.col("time_seconds").alias("cost"), "accuracy")
    return K.cost_curve(df, "top_k", tie="run_no").select("run_no", "top_k", "prev_cost", "prev_value", "slope")


# ---------------------------------------------------------------- vectors
def _group_sql(bits, size, sym):
    top = 2**bits - 1
    low = "CASE WHEN lo0 < 0 THEN -greatest(abs(lo0), hi0) ELSE lo0 END" if sym else "lo0"
    high = "greatest(abs(lo0), hi0)" if sym else "hi0"
    zero = str((top + 1) / 2) if sym else "round_even(-lo / scale, 0)"
    return f"""g AS (SELECT vec_id, embedding, unnest(range({64 // size})) AS g FROM embeddings),
 e AS (SELECT *, list_transform(embedding[g * {size} + 1:(g + 1) * {size}], lambda x: x::DOUBLE) AS part FROM g),
 b AS (SELECT *, least(list_min(part), 0.0::DOUBLE) AS lo0, greatest(list_max(part), 0.0::DOUBLE) AS hi0 FROM e),
 w AS (SELECT *, {low} AS lo, {high} AS hi FROM b),
 s AS (SELECT *, (hi - lo) / {top} AS scale FROM w),
 p AS (SELECT *, {zero}::DOUBLE AS zero FROM s)"""


@query("arr1_group_params", f"WITH {_group_sql(4, 16, False)} SELECT vec_id, CAST(g AS INTEGER) AS g, round(scale, 12) AS scale, zero FROM p")
def arr1(spark, folder):
    params = A.group_params(F.col("embedding"), 4, 16)
    df = table(spark, folder, "embeddings").select("vec_id", F.posexplode(params).alias("g", "p"))
    return df.select("vec_id", "g", F.round("p.scale", 12).alias("scale"), "p.zero")


@query("arr1_group_params_symmetric", f"WITH {_group_sql(8, 64, True)} SELECT vec_id, CAST(g AS INTEGER) AS g, round(scale, 12) AS scale, zero FROM p")
def arr1_sym(spark, folder):
    params = A.group_params(F.col("embedding"), 8, 64, sym=True)
    df = table(spark, folder, "embeddings").select("vec_id", F.posexplode(params).alias("g", "p"))
    return df.select("vec_id", "g", F.round("p.scale", 12).alias("scale"), "p.zero")


def _quant(bits, size):
    return f"""WITH {_group_sql(bits, size, False)},
 x AS (SELECT vec_id, g, scale, zero, unnest(part) AS x, unnest(range({size})) AS i FROM p),
 y AS (SELECT vec_id, g * {size} + i AS pos, x, scale * (least(greatest(round_even(x / scale, 0) + zero, 0), {2**bits - 1}) - zero) AS y FROM x)"""


@query("arr2_fake_quantize", _quant(4, 16) + " SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(y, 9) AS y FROM y")
def arr2(spark, folder):
    done = A.fake_quantize(F.col("embedding"), 4, 16)
    df = table(spark, folder, "embeddings").select("vec_id", F.posexplode(done).alias("pos", "y"))
    return df.select("vec_id", "pos", F.round("y", 9).alias("y"))


@query("arr2_ternary", f"""WITH {_group_sql(1, 16, False)},
 x AS (SELECT vec_id, g, lo, hi, unnest(part) AS x, unnest(range(16)) AS i FROM p)
 SELECT vec_id, CAST(g * 16 + i AS INTEGER) AS pos, CASE WHEN x > hi / 2 THEN hi ELSE 0 END + CASE WHEN x < lo / 2 THEN lo ELSE 0 END AS y FROM x""")
def arr2_ternary(spark, folder):
    done = A.fake_ternary(F.col("embedding"), 16)
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(done).alias("pos", "y"))


@query("arr2_quantize_error", " UNION ALL ".join(
    f"SELECT {b} AS bits, vec_id, round(err, 9) AS err FROM ({_quant(b, 64)} SELECT vec_id, max(abs(x - y)) AS err FROM y GROUP BY vec_id)" for b in (2, 3, 8)))
def arr2_error(spark, folder):
    df = table(spark, folder, "embeddings")
    out = None
    for bits in (2, 3, 8):
        done = A.fake_quantize(F.col("embedding"), bits, 64)
        gaps = F.zip_with("embedding", done, lambda x, y: F.abs(x.cast("double") - y))
        one = df.select(F.lit(bits).alias("bits"), "vec_id", F.round(F.array_max(gaps), 9).alias("err"))
        out = one if out is None else out.unionByName(one)
    return out
