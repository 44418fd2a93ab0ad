"""Evaluation-shaped tables derived from the given ones, in Spark and in SQL.

completions  an order is a question, its samples are numbered from 0 (2 to 8 of them)
runs         an order is a sweep run with a path to parse, an accuracy and a run time
logprobs     an embedding is the log-probabilities of a scored text
lines        a line item is one free-standing completion
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.completions import grade_completions
from ..operators.sweep import parse_run_path
from .registry import table


# ---------------------------------------------------------------- completions
def completions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    key, cust, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s")
    sampled = orders.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), cust % 7 + 1)))
    v = ((cust + s * (key % 4 + 1)) % 3).cast("string")
    code = (
        F.when((key + s) % 11 == 0, F.lit("No conclusion was reached."))
        .when((key + s) % 3 == 0, F.concat(F.lit("So the total is \\boxed{"), v, F.lit("}.")))
        .when((key + s) % 3 == 1, F.concat(F.lit("Thus the answer is "), v, F.lit(".")))
        .otherwise(F.concat(F.lit("We get 7 then "), v))
    )
    return sampled.select(
        key.alias("idx"),
        s.cast("int").alias("sample_id"),
        F.col("o_orderpriority").alias("type"),
        (key % 3).cast("string").alias("gt"),
        code.alias("code"),
        (((key * 31 + s * 17 + cust) % 1000) / 1000).alias("pred_score"),
    )


COMPLETIONS = r"""
f1 AS (
  SELECT o_orderkey AS idx, CAST(s AS INTEGER) AS sample_id, o_orderpriority AS type,
         CAST(o_orderkey % 3 AS VARCHAR) AS gt,
         CASE WHEN (o_orderkey + s) % 11 = 0 THEN 'No conclusion was reached.'
              WHEN (o_orderkey + s) % 3 = 0 THEN concat('So the total is ', chr(92), 'boxed{', v, '}.')
              WHEN (o_orderkey + s) % 3 = 1 THEN concat('Thus the answer is ', v, '.')
              ELSE concat('We get 7 then ', v) END AS code,
         CAST((o_orderkey * 31 + s * 17 + o_custkey) % 1000 AS DOUBLE) / 1000 AS pred_score
  FROM (SELECT *, CAST((o_custkey + s * (o_orderkey % 4 + 1)) % 3 AS VARCHAR) AS v
        FROM (SELECT *, unnest(range(o_custkey % 7 + 2)) AS s FROM orders)))"""

GRADED = (
    COMPLETIONS
    + r""",
ext AS (
  SELECT *, CASE WHEN contains(code, 'boxed{') THEN regexp_extract(code, 'boxed\{([^{}]*)\}', 1)
                 WHEN contains(code, 'he answer is')
                   THEN rtrim(trim(regexp_extract(code, 'he answer is(.*)$', 1)), '.')
                 ELSE coalesce(regexp_extract_all(code, '-?[0-9]*\.?[0-9]+')[-1], '') END AS pred
  FROM f1),
graded AS (
  SELECT * EXCLUDE (p, g),
         lower(pred) = lower(gt) OR coalesce(
           abs(p - g / 100) <= 1e-4 * greatest(abs(p), abs(g / 100))
           OR abs(p - g) <= 1e-4 * greatest(abs(p), abs(g))
           OR abs(p - g * 100) <= 1e-4 * greatest(abs(p), abs(g * 100)), false) AS score
  FROM (SELECT *, TRY_CAST(pred AS DOUBLE) AS p, TRY_CAST(gt AS DOUBLE) AS g FROM ext))"""
)


def graded(spark: SparkSession, folder: str) -> DataFrame:
    return grade_completions(completions(spark, folder))


# ---------------------------------------------------------------- runs
def runs(spark: SparkSession, folder: str) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    path = F.concat(
        F.lit("/out/"),
        F.when(cust % 2 == 0, "thinking_").otherwise(""),
        F.lit("checkpoint"), ((cust % 5 + 1) * 100).cast("string"),
        F.lit("_max_tokens_per_call"), F.when(cust % 3 == 0, "4096").otherwise("32000"),
        F.lit("/set/run_top_k"), (key % 6 + 1).cast("string"), F.lit("_metrics.json"),
    )
    return table(spark, folder, "orders").select(
        key.alias("run_no"),
        path.alias("file_path"),
        (F.col("o_totalprice") / 10000).alias("accuracy"),
        (F.col("o_totalprice") / 7).alias("time_seconds"),
    )


def parsed_runs(spark: SparkSession, folder: str) -> DataFrame:
    df = runs(spark, folder).withColumn("_r", parse_run_path(F.col("file_path")))
    top_k = F.regexp_extract("file_path", r"top_k(\d+)_metrics", 1).cast("long")
    return df.select(
        "run_no", "file_path", "accuracy", "time_seconds", "_r.checkpoint",
        "_r.max_tokens_per_call", "_r.is_thinking_mode", top_k.alias("top_k"),
    )


RUNS = r"""
f3 AS (
  SELECT o_orderkey AS run_no,
         concat('/out/', CASE WHEN o_custkey % 2 = 0 THEN 'thinking_' ELSE '' END, 'checkpoint',
                CAST((o_custkey % 5 + 1) * 100 AS VARCHAR), '_max_tokens_per_call',
                CASE WHEN o_custkey % 3 = 0 THEN '4096' ELSE '32000' END, '/set/run_top_k',
                CAST(o_orderkey % 6 + 1 AS VARCHAR), '_metrics.json') AS file_path,
         o_totalprice / 10000 AS accuracy, o_totalprice / 7 AS time_seconds
  FROM orders),
runs AS (
  SELECT *, CAST(regexp_extract(file_path, 'checkpoint([0-9]+)', 1) AS BIGINT) AS checkpoint,
         CAST(regexp_extract(file_path, 'max_tokens_per_call([0-9]+)', 1) AS BIGINT) AS max_tokens_per_call,
         contains(file_path, 'thinking_checkpoint') AS is_thinking_mode,
         CAST(regexp_extract(file_path, 'top_k([0-9]+)', 1) AS BIGINT) AS top_k
  FROM f3)"""


# ---------------------------------------------------------------- log-probabilities
def logprobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.col("label"),
        (F.col("vec_id") % 16 + 1).cast("int").alias("prompt_len"),
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"),
    )


LOGPROBS = r"""
f4 AS (
  SELECT vec_id AS idx, label, CAST(vec_id % 16 + 1 AS INTEGER) AS prompt_len,
         list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS lp
  FROM embeddings),
nll AS (
  SELECT *, -list_sum(lp[prompt_len + 1:]) / (len(lp) - prompt_len) AS nll FROM f4)"""


# ---------------------------------------------------------------- lines
def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the whole numbers the composed texts are made of."""
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return li.select(
        F.col("l_orderkey").alias("idx"),
        F.col("l_linenumber").alias("kind"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("int").alias("q"),
    )


LINES = r"""
li AS (
  SELECT l_orderkey AS idx, l_linenumber AS kind, l_partkey AS part, l_suppkey AS supp,
         CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""


def by_kind(branches: dict, otherwise):
    """CASE over ``kind``: pieces of text and columns, joined."""

    def text(parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    column = None
    for kind, parts in branches.items():
        hit = F.col("kind") == kind
        column = F.when(hit, text(parts)) if column is None else column.when(hit, text(parts))
    return column.otherwise(text(otherwise))


def q(name: str = "q"):
    return F.col(name).cast("string")
