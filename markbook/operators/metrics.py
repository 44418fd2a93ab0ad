"""Accuracy tables over graded completions in long form (one row per question and sample).

Sample ids count from 0 within a question.  Every aggregate combines on the map side, so a
question with very many samples costs no task more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cards import minutes_seconds
from ..session import settle


def _score() -> Column:
    return F.col("score").cast("int")


def rounded_percent(ratio: Column) -> Column:
    """Percent with one decimal, ties to even."""
    return F.bround((ratio * 100).cast("double"), 1)


def per_question(graded: DataFrame, keys=("idx",), carry=()) -> DataFrame:
    """One row per question: sample count, first score, last score, last prediction empty."""
    missing = F.coalesce(F.col("pred"), F.lit("")) == ""
    return graded.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(_score(), "sample_id").alias("first_score"),
        F.max_by(_score(), "sample_id").alias("last_score"),
        F.max_by(missing.cast("int"), "sample_id").alias("last_empty"),
        *[F.max(c).alias(c) for c in carry],
    )


def accuracy(graded: DataFrame, by=()) -> DataFrame:
    """Samples, scores, empty answers and accuracy of the first sample."""
    by = list(by)
    questions = per_question(graded, [*by, "idx"])
    ratio = F.sum("first_score") / F.count("*")
    table = questions.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        F.sum("n").alias("num_scores"),
        F.sum("last_empty").alias("empty_samples"),
        ratio.alias("acc_ratio"),
    )
    return table.withColumn("acc", rounded_percent(F.col("acc_ratio")))


def type_accuracy(graded: DataFrame, by=("type",)) -> DataFrame:
    """Accuracy of the last sample per question type."""
    by = list(by)
    questions = per_question(graded, [*by, "idx"])
    table = questions.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        (F.sum("last_score") / F.count("*")).alias("acc_ratio"),
    )
    return table.withColumn("acc", rounded_percent(F.col("acc_ratio")))


def metrics_record(graded: DataFrame, seconds: float | None = None) -> DataFrame:
    """The flat metrics record of a run, with the per-type map in type order and the time it took.

    Accuracy and types come from one pass, so that each completion is graded once: questions per type,
    questions, types, all.
    """
    missing = F.coalesce(F.col("pred"), F.lit("")) == ""
    parts = graded.groupBy("type", "idx").agg(
        F.count("*").alias("n"),
        F.min("sample_id").alias("first_id"),
        F.max("sample_id").alias("last_id"),
        F.min_by(_score(), "sample_id").alias("first_score"),
        F.max_by(_score(), "sample_id").alias("last_score"),
        F.max_by(missing.cast("int"), "sample_id").alias("last_empty"),
    )
    questions = parts.groupBy("idx").agg(
        F.sum("n").alias("n"),
        F.min_by("first_score", "first_id").alias("first_score"),
        F.max_by("last_empty", "last_id").alias("last_empty"),
        F.collect_list(F.struct("type", "last_score")).alias("types"),
    )
    # A question of several types counts once in the total: with the first of them.
    each = questions.select("n", "first_score", "last_empty", F.posexplode("types").alias("at", "t"))
    once = F.col("at") == 0
    types = each.groupBy("t.type").agg(
        F.count_if(once).alias("questions"),
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in ("n", "first_score", "last_empty")],
        rounded_percent(F.sum("t.last_score") / F.count("*")).alias("acc"),
    )
    count = F.coalesce(F.sum("questions"), F.lit(0).cast("long"))
    total = types.agg(
        count.alias("num_samples"),
        F.sum("n").alias("num_scores"),
        F.sum("last_empty").alias("empty_samples"),
        (F.sum("first_score") / count).alias("acc_ratio"),
        F.collect_list(F.struct("type", "acc")).alias("_types"),
    )
    timed = []
    if seconds is not None:
        timed = [
            F.lit(float(seconds)).alias("time_use_in_second"),
            minutes_seconds(F.lit(float(seconds))).alias("time_use_in_minite"),
        ]
    return total.select(
        "num_samples",
        "num_scores",
        "empty_samples",
        "acc_ratio",
        rounded_percent(F.col("acc_ratio")).alias("acc"),
        F.lit(0).cast("long").alias("timeout_samples"),
        *timed,
        F.map_from_entries(F.array_sort("_types")).alias("type_acc"),
    )


def position_curve(graded: DataFrame, span: int = 4096) -> DataFrame:
    """Mean score per sample position, short questions padded with their last score.

    At position p that is (scores at p + last scores of the questions that ended before p) over
    the number of questions.  Both parts are small aggregates, so nothing is padded for real.
    Running sums go over position ranges of ``span`` with an offset per range.
    """
    rows = graded.select(
        "idx", F.col("sample_id").cast("long").alias("position"), "sample_id", _score().alias("s")
    )
    # One pass gives both kinds of rows: per position its scores, per question its length and end.
    both = rows.groupingSets([[F.col("idx")], [F.col("position")]], "idx", "position").agg(
        F.count("*").alias("n"),
        F.sum("s").alias("here"),
        F.max_by("s", "sample_id").alias("last"),
        F.grouping("idx").alias("per_position"),
    )
    is_position, nothing = F.col("per_position") == 1, F.lit(0).cast("long")
    joint = settle(
        both.select(
            F.when(is_position, F.col("position")).otherwise(F.col("n")).alias("position"),
            F.when(is_position, F.col("here")).otherwise(nothing).alias("here"),
            F.when(is_position, nothing).otherwise(F.col("last").cast("long")).alias("ended"),
            F.when(is_position, nothing).otherwise(F.lit(1).cast("long")).alias("questions"),
        )
        .groupBy("position")
        .agg(*[F.sum(c).alias(c) for c in ("here", "ended", "questions")])
    ).withColumn("range", F.floor(F.col("position") / span))
    upto = Window.partitionBy("range").orderBy("position").rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        joint.groupBy("range")
        .agg(F.sum("ended").alias("e"), F.sum("questions").alias("q"))
        .select(
            "range",
            F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("e0"),
            F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q0"),
            F.sum("q").over(Window.partitionBy()).alias("total"),
        )
    )
    curve = joint.withColumn("e", F.sum("ended").over(upto)).join(offsets, "range")
    # The row one past the longest question only closes the sums.
    return (
        curve.withColumn("q", F.col("q0") + F.sum("questions").over(upto))
        .filter(F.col("q") < F.col("total"))
        .select(
            "position",
            ((F.col("here") + F.col("e0") + F.col("e")) / F.col("total")).alias("mean_score"),
        )
    )


def macro_average(per_dataset: DataFrame, dataset: str = "dataset", acc: str = "acc") -> DataFrame:
    """The per-dataset rows and an unweighted ``avg`` row."""
    average = per_dataset.agg(F.avg(acc).alias(acc)).select(F.lit("avg").alias(dataset), acc)
    return per_dataset.select(dataset, acc).unionByName(average)
