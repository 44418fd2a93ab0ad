"""Sweep analysis: path parsing, grouped statistics, pivots, rankings, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import exact_quantiles

# The names of run folders and metric files.
METRIC_FILE = (
    r"^test_qwen25-math-cot_-1_seed0_t0\.0_top_k(\d+)_enable_thinking(True|False)"
    r"_s0_e-1_qwen25-math-cot_metrics\.json"
)


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_run_path(path: Column) -> Column:
    """``struct<checkpoint, max_tokens_per_call, is_thinking_mode>`` from a run folder."""
    thinking = path.contains("thinking_checkpoint")
    checkpoint = F.when(thinking, _extract(path, r"thinking_checkpoint(\d+)")).otherwise(
        _extract(path, r"checkpoint(\d+)")
    )
    return F.struct(
        checkpoint.cast("long").alias("checkpoint"),
        _extract(path, r"max_tokens_per_call(\d+)").cast("long").alias("max_tokens_per_call"),
        thinking.alias("is_thinking_mode"),
    )


def parse_metric_file(name: Column, pattern: str = METRIC_FILE) -> Column:
    """``struct<top_k, enable_thinking>`` from a metrics file name; null when it does not match."""
    return F.when(
        name.rlike(pattern),
        F.struct(
            F.regexp_extract(name, pattern, 1).cast("long").alias("top_k"),
            (F.regexp_extract(name, pattern, 2) == "True").alias("enable_thinking"),
        ),
    )


def grouped_stats(runs: DataFrame, by: str, value: str = "accuracy", digits: int = 2) -> DataFrame:
    """Mean, sample standard deviation and count per setting."""
    return runs.groupBy(by).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("std"),
        F.count(value).alias("count"),
    )


def stats_by_each(runs: DataFrame, settings, value: str = "accuracy", digits: int = 2) -> DataFrame:
    """``grouped_stats`` for several settings in one pass (grouping sets)."""
    sets = [[F.col(s)] for s in settings]
    table = runs.groupingSets(sets, *[F.col(s) for s in settings]).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("std"),
        F.count(value).alias("count"),
        *[F.grouping(s).alias(f"_g_{s}") for s in settings],
    )
    name = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for s in settings:
        name = F.when(F.col(f"_g_{s}") == 0, F.lit(s)).otherwise(name)
        level = F.when(F.col(f"_g_{s}") == 0, F.col(s).cast("string")).otherwise(level)
    return table.select(name.alias("setting"), level.alias("level"), "mean", "std", "count")


def pivot_mean(runs: DataFrame, index, column: str, values, value: str = "accuracy", digits: int | None = None) -> DataFrame:
    """Mean per index and column value; the column values are given, so no extra job runs."""
    table = runs.groupBy(*index).pivot(column, list(values)).agg(F.avg(value))
    shown = [F.col(str(v)) if digits is None else F.bround(F.col(str(v)), digits) for v in values]
    return table.select(*index, *[c.alias(f"{column}_{v}") for c, v in zip(shown, values)])


def _with_one(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(1).alias("_one"))


def describe(runs: DataFrame, value: str = "accuracy") -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum (one row)."""
    basic = runs.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(runs, value, (0.25, 0.5, 0.75), ("p25", "p50", "p75"))
    return _with_one(basic).join(_with_one(quartiles), "_one").select(
        "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def five_numbers(runs: DataFrame, by: str, value: str = "accuracy") -> DataFrame:
    """Box-plot numbers per group: minimum, exact quartiles, maximum."""
    names = ("low", "q1", "median", "q3", "high")
    return exact_quantiles(runs, value, (0.0, 0.25, 0.5, 0.75, 1.0), names, [by])


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
        ).alias("_r")
    ).select("_r.*")


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(flag)).alias("true_count"), F.count_if(~F.col(flag)).alias("false_count")
    )


def hour_stats(runs: DataFrame, seconds: str = "time_seconds") -> DataFrame:
    hours = runs.select((F.col(seconds) / 3600).alias("hours"))
    basic = hours.agg(
        F.avg("hours").alias("mean_hours"), F.min("hours").alias("min_hours"),
        F.max("hours").alias("max_hours"),
    )
    median = exact_quantiles(hours, "hours", (0.5,), ("median_hours",))
    return _with_one(basic).join(_with_one(median), "_one").drop("_one")


def above_quantile(runs: DataFrame, columns, share: float = 0.9) -> DataFrame:
    """Rows above the exact quantile of any of the columns (one row of limits, broadcast)."""
    kept, hit = _with_one(runs), F.lit(False)
    for c in columns:
        limit = exact_quantiles(runs, c, (share,), (f"_q_{c}",))
        kept = kept.join(F.broadcast(_with_one(limit)), "_one")
        hit = hit | (F.col(c) > F.col(f"_q_{c}"))
    return kept.filter(hit).select(*runs.columns)


def best_row(runs: DataFrame, value: str, keys, tie: str) -> DataFrame:
    """The row with the highest value; the smallest ``tie`` among equals."""
    order = F.struct(F.col(value), (-F.col(tie)).alias("early"))
    return runs.agg(F.max_by(F.struct(*keys, value), order).alias("_b")).select("_b.*")


def top_rows(runs: DataFrame, value: str, n: int, columns, tie: str, lowest: bool = False) -> DataFrame:
    order = F.col(value).asc() if lowest else F.col(value).desc()
    return runs.orderBy(order, F.col(tie).asc()).limit(n).select(*columns)


def summary(runs: DataFrame) -> DataFrame:
    """Count, best, worst and average accuracy and the sorted setting lists."""
    def levels(c):
        return F.sort_array(F.collect_set(c))

    return runs.agg(
        F.count("*").alias("total_experiments"),
        F.max("accuracy").alias("best_accuracy"),
        F.min("accuracy").alias("worst_accuracy"),
        F.avg("accuracy").alias("average_accuracy"),
        levels("checkpoint").alias("checkpoints"),
        levels("top_k").alias("top_k_values"),
        levels("max_tokens_per_call").alias("max_tokens_values"),
    )


def setting_table(runs: DataFrame) -> DataFrame:
    """Accuracy table in reading order: checkpoint, token budget, top-k.

    Accuracy closes the sort key, so a setting with very many runs spans several sort ranges.
    """
    order = ["checkpoint", "max_tokens_per_call", "top_k", "accuracy"]
    return runs.select(*order).orderBy(*order)


def sweep_grid(spark: SparkSession, settings: dict[str, list]) -> DataFrame:
    """Every combination of the setting values, one row per task id.

    A task id is read as a mixed-radix number, the last setting changing fastest.
    """
    total = 1
    for name, values in settings.items():
        if not values:
            raise ValueError(f"setting '{name}' has no values")
        total *= len(values)
    return decode_tasks(spark.range(total).withColumnRenamed("id", "task_id"), settings)


def decode_tasks(tasks: DataFrame, settings: dict[str, list], task: str = "task_id") -> DataFrame:
    """Setting values of each task id."""
    product = 1
    for values in settings.values():
        product *= len(values)
    columns = []
    for name, values in settings.items():
        product //= len(values)
        place = F.floor(F.col(task) / product) % len(values)
        columns.append(
            F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int")).alias(name)
        )
    return tasks.select("*", *columns)


def missing_runs(grid: DataFrame, runs: DataFrame, keys) -> DataFrame:
    """Grid cells without a result."""
    return grid.join(runs.select(*keys).distinct(), list(keys), "left_anti")
