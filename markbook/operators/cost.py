"""Cost, likelihood and latency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import bytes_per_value, mean_negative_logprob
from .ordering import order_buckets
from .voting import ballots, majority


def question_cost(df: DataFrame, models: DataFrame, by=("run_id", "idx"), votes: bool = False) -> DataFrame:
    """Memory-traffic cost per question from one row per sample.

    ``df`` has model, input_tokens, output_tokens, wbits, abits and groupsize; ``models`` one row
    per model.  The cost needs only the longest output and the sum of n(n+1)/2 over the outputs,
    so the samples are never gathered into a list.  With ``votes`` the same aggregate counts the samples'
    ``score`` and adds ``best_of_n_score``, the majority (a tie goes to the least ``sample_id``).
    """
    n = F.col("output_tokens").cast("double")
    same = ["model", "wbits", "abits", "groupsize"]
    sums = df.groupBy(*by, *same).agg(
        F.max("input_tokens").alias("input_tokens"),
        F.max("output_tokens").alias("longest"),
        F.sum(n * (n + 1) / 2).alias("grown"),
        *(ballots() if votes else []),
    )
    won = [majority().alias("best_of_n_score")] if votes else []
    hidden = F.col("hidden_dim").cast("double")
    head_dim = F.floor(F.col("hidden_dim") / F.col("num_heads")).cast("double")
    weights = F.col("num_layers") * (4 * hidden * hidden + 3 * hidden * F.col("intermediate_dim"))
    per_token = (
        2 * F.col("num_layers") * head_dim * F.col("num_kv_heads")
        * bytes_per_value(F.col("abits"), F.col("groupsize"))
    )
    return (
        sums.join(models, "model")
        .withColumn(
            "weight_ops",
            (F.col("longest") + 1) * weights * bytes_per_value(F.col("wbits"), F.col("groupsize")),
        )
        .withColumn(
            "kv_ops", F.col("grown") * per_token + F.col("longest") * (per_token * F.col("input_tokens"))
        )
        .withColumn("cost", F.col("weight_ops") + F.col("kv_ops"))
        .select(*by, *same, "weight_ops", "kv_ops", "cost", *won)
    )


def cost_rollup(costs: DataFrame, by=("run_id",)) -> DataFrame:
    """Mean vote score and cost totals per run, with the largest single cost; ``costs`` come with votes."""
    return costs.groupBy(*by).agg(
        F.avg(F.col("best_of_n_score").cast("int")).alias("average_score"),
        F.sum("weight_ops").alias("weight_ops"),
        F.sum("kv_ops").alias("kv_ops"),
        F.sum("cost").alias("total_cost"),
        F.max("cost").alias("max_cost"),
    )


def normalized_cost(df: DataFrame, cost: str = "cost") -> DataFrame:
    """Cost over the largest cost (a one-row aggregate, broadcast)."""
    one = F.lit(1).alias("_one")
    top = df.agg(F.max(cost).alias("_max"))
    return (
        df.select("*", one)
        .join(F.broadcast(top.select("*", one)), "_one")
        .withColumn("normalized_cost", F.col(cost) / F.col("_max"))
        .drop("_one", "_max")
    )


def cost_curve(df: DataFrame, series: str, cost: str = "cost", value: str = "accuracy", tie: str | None = None) -> DataFrame:
    """Points of each series in cost order, with the point before and the slope to it.

    A series is split into ranges along the sort order (also inside a cost that repeats very
    often), so one long series does not sit in one task; the last point of the range before
    carries over.
    """
    order = [cost, value, *([tie] if tie else [])]
    point = F.struct(*order)
    ranges = order_buckets(df, order)
    names = [f"_b{i}" for i in range(len(ranges))]
    bucketed = df.select("*", *ranges)
    inside = Window.partitionBy(series, *names).orderBy(*order)
    ends = bucketed.groupBy(series, *names).agg(F.max(point).alias("_end"))
    # One row per series and range.
    carried = ends.select(
        series,
        *names,
        F.lag("_end").over(Window.partitionBy(series).orderBy(*names)).alias("_before"),
    )
    linked = (
        bucketed.withColumn("_prev", F.lag(point).over(inside))
        .join(carried, [series, *names])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
    )
    run = F.col(cost) - F.col(f"_prev.{cost}")
    rise = F.col(value) - F.col(f"_prev.{value}")
    return linked.select(
        *df.columns,
        F.col(f"_prev.{cost}").alias("prev_cost"),
        F.col(f"_prev.{value}").alias("prev_value"),
        F.try_divide(rise, run).alias("slope"),
    )


def question_nll(logprobs: DataFrame) -> DataFrame:
    """Mean negative log-probability per text, behind its prompt."""
    return logprobs.withColumn("nll", mean_negative_logprob(F.col("lp"), F.col("prompt_len")))


def mean_nll(logprobs: DataFrame, by=()) -> DataFrame:
    return question_nll(logprobs).groupBy(*by).agg(F.avg("nll").alias("mean_nll"))


def perplexity(windows: DataFrame, nll_sum: Column, tokens: Column, by=()) -> DataFrame:
    """exp(sum of negative log-likelihoods / tokens)."""
    return windows.groupBy(*by).agg(F.exp(F.sum(nll_sum) / F.sum(tokens)).alias("perplexity"))


def nll_spread(results: DataFrame, value: str = "mean_nll") -> DataFrame:
    """Mean and population deviation over runs."""
    return results.agg(
        F.count(value).alias("files"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def mean_latency(timings: DataFrame, by, run_no: str = "run_no", seconds: str = "seconds", warmups: int = 1, timed: int | None = None) -> DataFrame:
    """Mean of the timed runs (all, or the first ``timed``); warm-up runs, numbered first, are left out."""
    kept = timings.filter(F.col(run_no) >= warmups)
    if timed is not None:
        kept = kept.filter(F.col(run_no) < warmups + timed)
    return kept.groupBy(*by).agg(F.avg(seconds).alias("avg_latency"), F.count("*").alias("timed_runs"))
