"""Votes over the samples of a question.

A vote is two plain aggregates: votes per (question, answer), then the winner per question.  The
first one combines map-side, so even a question with a third of all rows is reduced to its
distinct answers before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import closed_form, grade
from ..functions.normalize import normalize_answer
from ..functions.numbers import parse_digits
from ..session import settle


def equivalence_key(pred: Column) -> Column:
    """Answers with equal keys count as one: the number value, else the normalised text.

    Unlike pairwise comparison against earlier answers the key is transitive.
    """
    value = F.coalesce(parse_digits(pred), closed_form(pred))
    number = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.coalesce(number.cast("string"), normalize_answer(pred))


def vote(df: DataFrame, keys=("idx",), answer: str | Column = "pred", carry=("pred",)) -> DataFrame:
    """Most frequent answer per group; among equals the one seen first wins.

    ``carry`` columns come from the winner's first sample.
    """
    keys = list(keys)
    choice = F.col(answer) if isinstance(answer, str) else answer
    ballots = (
        df.withColumn("_choice", choice)
        .groupBy(*keys, "_choice")
        .agg(
            F.count("*").alias("_votes"),
            F.min("sample_id").alias("_seen"),
            *[F.min_by(c, "sample_id").alias(c) for c in carry],
        )
    )
    # More votes first, then the earlier sample, as one number: sample ids stay below 2**31.
    last = 2**31 - 1
    ranked = ballots.withColumn("_rank", F.col("_votes") * F.lit(last + 1) + (F.lit(last) - F.col("_seen")))
    return ranked.groupBy(*keys).agg(
        *[F.max_by(c, "_rank").alias(c) for c in carry], F.max("_votes").alias("votes")
    )


def greedy_vote(df: DataFrame, keys=("idx",), answer: str = "pred", carry=("pred",)) -> DataFrame:
    """Most frequent class of equal answers per group; among equals the class opened first wins.

    An answer joins the first class whose opening answer it is graded equal to, in the order of the
    samples, else it opens one.  Equality by tolerance isn't transitive, so the order matters, unlike
    with ``equivalence_key``.  Each round settles one class of every group at once: the earliest answer
    left opens it.  There are as many rounds as the group with most classes has, each over the distinct
    answers that are left.  ``carry`` columns come from the class's first sample; null answers are a
    class of their own.
    """
    keys = list(keys)
    answers = df.withColumn("_text", normalize_answer(F.col(answer))).groupBy(*keys, "_text").agg(
        F.count("*").alias("_votes"), F.min("sample_id").alias("_seen"), *[F.min_by(c, "sample_id").alias(f"_own_{c}") for c in carry]
    )
    left, classes = settle(answers), None
    while not left.isEmpty():
        heads = left.groupBy(*[F.col(c).alias(f"_key_{c}") for c in keys]).agg(
            F.min("_seen").alias("_class"), F.min_by("_text", "_seen").alias("_head")
        )
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        met = settle(grade(left.join(heads, same), "_text", "_head").withColumn("_in", F.col("score") | (F.col("_seen") == F.col("_class"))))
        part = met.filter("_in").select(*keys, "_class", "_votes", "_seen", *[f"_own_{c}" for c in carry])
        classes = part if classes is None else classes.unionByName(part)
        left = met.filter("NOT _in").select(*left.columns)
    if classes is None:
        classes = left.withColumn("_class", F.col("_seen"))
    sizes = classes.groupBy(*keys, "_class").agg(
        F.sum("_votes").alias("_votes"), *[F.min_by(f"_own_{c}", "_seen").alias(c) for c in carry]
    )
    last = 2**31 - 1
    ranked = sizes.withColumn("_rank", F.col("_votes") * F.lit(last + 1) + (F.lit(last) - F.col("_class")))
    return ranked.groupBy(*keys).agg(*[F.max_by(c, "_rank").alias(c) for c in carry], F.max("_votes").alias("votes"))


def maj_at_k(graded: DataFrame, k: int, key: str = "text", by=()) -> DataFrame:
    """Share of questions whose majority answer among the first ``k`` samples is right.

    ``key="text"`` votes by answer text, ``"normalized"`` by normalised text, ``"value"`` by
    equivalence key, ``"greedy"`` by grading against the classes so far.
    """
    first_k = graded.filter(F.col("sample_id") < k)
    if key == "greedy":
        return _share(greedy_vote(first_k, [*by, "idx"], carry=("score",)), "score", f"maj_at_{k}", by)
    answers = {"text": F.col, "normalized": lambda c: normalize_answer(F.col(c)), "value": lambda c: equivalence_key(F.col(c))}
    answer = answers[key]("pred")
    won = vote(first_k, [*by, "idx"], answer, carry=("score",))
    return _share(won, "score", f"maj_at_{k}", by)


def rm_at_k(graded: DataFrame, k: int, reward: str = "pred_score", by=()) -> DataFrame:
    """Share of questions whose best-rewarded sample among the first ``k`` is right.

    Of equal rewards the first sample counts.  Both steps keep numbers only, so they are hashed and
    combined before the shuffle.
    """
    first_k = graded.filter(F.col("sample_id") < k)
    earliest = first_k.groupBy(*by, "idx", reward).agg(F.min_by("score", "sample_id").alias("score"))
    best = earliest.groupBy(*by, "idx").agg(F.max_by("score", reward).alias("score"))
    return _share(best, "score", f"rm_at_{k}", by)


def short_questions(graded: DataFrame, k: int, by=()) -> DataFrame:
    """How many questions have fewer than ``k`` samples, and so make a figure at k worth less."""
    sizes = graded.groupBy(*by, "idx").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if(F.col("n") < k).alias("short"))


def _share(df: DataFrame, score: str, name: str, by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("questions"),
        (F.sum(F.col(score).cast("int")) / F.count("*")).alias(name),
    )


def ballots() -> list[Column]:
    """Counts of right and wrong scores of a group, and its first score."""
    right = F.sum(F.col("score").cast("int"))
    return [right.alias("right"), (F.count("score") - right).alias("wrong"), F.min_by("score", "sample_id").alias("first")]


def majority() -> Column:
    """Winner of ``ballots``; a tie goes to the first sample."""
    more = F.when(F.col("right") > F.col("wrong"), True).when(F.col("right") < F.col("wrong"), False)
    return more.otherwise(F.col("first"))


def bool_majority(graded: DataFrame, keys=("idx",)) -> DataFrame:
    """Majority of the scores per question; a tie goes to the first sample."""
    return graded.groupBy(*keys).agg(*ballots()).withColumn("best_of_n_score", majority()).drop("first")
