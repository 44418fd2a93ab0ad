"""Completions: joining, resuming, de-duplicating, comparing runs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import completion_text, cut_at_stop_words, predict, repair_choice
from ..functions.grading import grade
from ..session import settle
from .adapters import with_ground_truth
from .prompts import stop_words_for


def clean_completions(df: DataFrame, prompt_type: str, text: str = "text", prompt: str = "prompt") -> DataFrame:
    """``code``: the text behind the prompt, cut at the stop words of the prompt type."""
    code = completion_text(F.col(text), F.col(prompt))
    return df.withColumn("code", cut_at_stop_words(code, stop_words_for(prompt_type)))


@lru_cache(maxsize=64)
def _prediction(dataset: str, prompt_type: str, application: str) -> Column:
    """The prediction column; a large expression, so it is built once per application."""
    found = predict(F.col("code"), prompt_type, dataset)
    return repair_choice(found, F.col("gt"), F.col("code"))


def with_predictions(df: DataFrame, dataset: str, prompt_type: str = "cot") -> DataFrame:
    """``pred`` from ``code``, put into choice form where ``gt`` is one."""
    application = df.sparkSession.sparkContext.applicationId
    return df.withColumn("pred", _prediction(dataset, prompt_type, application))


def grade_completions(df: DataFrame, dataset: str = "math", prompt_type: str = "cot") -> DataFrame:
    return grade(with_predictions(df, dataset, prompt_type))


def grade_distinct(df: DataFrame) -> DataFrame:
    """Grade each distinct (pred, gt) pair once and join the result back.

    Pays off when samples repeat many answers and the answers need the dearer rungs.  The graded
    pairs are kept; whether they are broadcast is decided by their size when they are joined.
    """
    graded = grade(df.select("pred", "gt").distinct())
    named = graded.withColumnsRenamed({"pred": "_pred", "gt": "_gt"})
    pairs = settle(named)
    same = F.col("pred").eqNullSafe(F.col("_pred")) & F.col("gt").eqNullSafe(F.col("_gt"))
    return df.join(pairs, same).select(*df.columns, "score", "rung")


def remaining(questions: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Questions that have no finished result yet."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


def attach_results(samples: DataFrame, results: DataFrame, keys=("idx", "sample_id")) -> DataFrame:
    return samples.join(results, list(keys))


def last_record(df: DataFrame, keys, order: Column) -> DataFrame:
    """One record per key: the one loaded last (``order`` must be unique within a key)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(
        *keys, "_last.*"
    )


def grouped_samples(df: DataFrame, fields=("code", "pred", "score"), chunk: int | None = None) -> DataFrame:
    """Wide form for a sink: parallel lists in sample order, one row per question.

    The long form is the one to store where a question may have very many samples.  With ``chunk`` a
    question goes on in further rows (``part`` 1, 2, ...) after so many samples.
    """
    sample = F.struct("sample_id", *fields)
    part = [F.floor(F.col("sample_id") / chunk).cast("int").alias("part")] if chunk else []
    lists = df.groupBy("idx", *part).agg(F.array_sort(F.collect_list(sample)).alias("_s"))
    return lists.select("idx", *(["part"] if chunk else []), *[F.col(f"_s.{f}").alias(f) for f in fields])


def long_samples(wide: DataFrame) -> DataFrame:
    """Stored results, one row per question with parallel lists, as one row per sample.

    Lists are ``code``, ``pred``, ``report``, ``score`` and ``pred_score`` as far as present; a reward
    list of lists is flattened first.  A shorter list leaves nulls at its end; other columns repeat.
    """
    lists = [c for c in ("code", "pred", "report", "score", "pred_score") if c in wide.columns]
    rewards = wide.schema["pred_score"].dataType.simpleString() if "pred_score" in lists else ""
    if rewards.startswith("array<array"):
        wide = wide.withColumn("pred_score", F.flatten("pred_score"))
    rest = [c for c in wide.columns if c not in (*lists, "sample_id")]
    each = wide.select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("sample_id", "_s"))
    return each.select(*rest, "sample_id", *[F.col(f"_s.{c}").alias(c) for c in lists])


def evaluate(wide: DataFrame, dataset: str, order: Column | None = None) -> DataFrame:
    """Stored results, one row per question with lists, graded anew: one row per sample.

    Of a question stored more than once the last record by ``order`` counts; the gold answer is derived
    again, then every prediction is compared with it.
    """
    kept = last_record(wide, ["idx"], order) if order is not None else wide
    gold = with_ground_truth(kept, dataset)
    rest = [c for c in ("pred", "code", "report", "pred_score") if c in gold.columns]
    return grade(long_samples(gold.select("idx", *[c for c in gold.columns if c not in ("idx", "score", *rest)], *rest)))


def regressions(run_a: DataFrame, run_b: DataFrame, key: str = "idx") -> DataFrame:
    """Questions right in run A and wrong in run B."""
    a = run_a.select(key, F.col("score").alias("score_a"))
    b = run_b.select(key, F.col("score").alias("score_b"))
    return a.join(b, key).filter(F.col("score_a") & ~F.col("score_b")).select(key)


def transitions(run_a: DataFrame, run_b: DataFrame, key: str = "idx") -> DataFrame:
    """How many questions moved between right and wrong from run A to run B."""
    a = run_a.select(key, F.col("score").alias("score_a"))
    b = run_b.select(key, F.col("score").alias("score_b"))
    return a.join(b, key).groupBy("score_a", "score_b").agg(F.count("*").alias("questions"))


def append_new(processed: DataFrame, new: DataFrame) -> DataFrame:
    return processed.unionByName(new, allowMissingColumns=True)
