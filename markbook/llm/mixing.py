"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies.  Documents stand in the order of
(size, digest of the id), their expected copies are summed up from the front, one random offset is
added, and a document is emitted once for each integer that its stretch of the sum crosses.  The
order by size spreads the copies over short and long documents alike, so the words taken differ
from the target by little more than the longest document.

Sums over a source are never made in one task: rows are sorted into ranges, each range counts its
rows per source, and the few counts are summed up.  The range is written down with its rows, so a
recomputation after a lost executor sees the same ranges.

Defined results: a null or blank text has size 0; a null source is a source of its own, weighed
last; a source without words has target 0; equal rows are told apart by their place only; an empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, source_size) the target of each source.

    No target may exceed ``most`` times its source's size; what is cut off goes to the others by
    weight.  With the sources in the order of cap / weight, the first k are cut, and the rest share
    what remains: the highest such level under which the next source stays below its cap.  One row a
    source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("__cap") / F.col("__w"), F.col("__no"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    weighed = sizes.withColumn("__no", F.row_number().over(order)).select(
        "*",
        F.get(F.array(*map(F.lit, weights)), ((F.col("__no") - 1) % len(weights)).cast("int")).alias("__w"),
        (F.col("source_size") * F.lit(most)).alias("__cap"),
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum(
        "__w"
    ).over(rest)
    levelled = weighed.withColumn("__level", level).withColumn(
        "__shared", F.max(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))).over(everything)
    )
    return levelled.select(
        "source",
        "source_size",
        F.least("__cap", F.coalesce(F.col("__shared") * F.col("__w"), F.col("__cap"))).alias("target"),
    )


def _offset(source: F.Column, seed: str) -> F.Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("-"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(
    docs: DataFrame,
    key: F.Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, copies and ``__key``."""
    thin = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")).alias("__order"),
            (F.lit(0) if key is None else key).alias("__key"),
        ),
        "mix-sizes",
    )
    aim = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ranged = stored(
        thin.repartitionByRange(F.col("source"), "size", "__order", "doc_id").withColumn(
            "__range", F.spark_partition_id()
        ),
        "mix-ranges",
    )
    counts = ranged.groupBy("source", "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("source", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    a, b = starts.alias("a"), aim.alias("b")
    known = a.join(b, F.expr("a.source <=> b.source"), "left").select(
        F.col("a.source").alias("__source"), F.col("__range").alias("__at"), "__start", "source_size", "target"
    )
    own = W.partitionBy("source", "__range").orderBy("size", "__order", "doc_id")
    ranked = (
        ranged.withColumn("__row", F.row_number().over(own))
        .join(known, F.expr("source <=> __source AND __range = __at"), "left")
        .withColumn("__rank", F.col("__start") + F.col("__row"))
        .withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("__u", _offset(F.col("source"), seed))
    )
    copies = F.floor(F.col("__rank") * F.col("__rate") + F.col("__u")) - F.floor(
        (F.col("__rank") - 1) * F.col("__rate") + F.col("__u")
    )
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "__key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is emitted, with all its columns.

    Copies are joined back by a digest of the row; rows that agree in id, source and text are
    interchangeable and share their copies out by number.
    """
    own = F.xxhash64("doc_id", "source", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    shares = plan(docs, own, **options).groupBy("__key").agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")
    )
    number = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
    upto = lambda n: F.floor(n * F.col("__copies") / F.col("__rows"))
    return (
        docs.withColumn("__key", own)
        .join(shares.where("__copies > 0"), "__key")
        .withColumn("__no", number)
        .withColumn("__own", upto(F.col("__no")) - upto(F.col("__no") - 1))
        .where("__own > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own"))))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


TAKEN_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS o
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((no - 1) % 3 AS INTEGER) + 1] AS w,
         CAST(source_size AS DOUBLE) * 3.0 AS cap FROM totals),
levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
shared AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS s FROM levelled),
aim AS (SELECT source, source_size, least(cap, coalesce(s * w, cap)) AS target,
               CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '-')), 1, 8) AS BIGINT) AS DOUBLE)
                 / 4294967296.0 AS u FROM shared),
ranked AS (
  SELECT d.doc_id, d.source, d.size, a.source_size, a.target, a.u,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.o, d.doc_id) AS r
  FROM sized d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
copied AS (SELECT *, CAST(floor(r * rate + u) - floor((r - 1) * rate + u) AS BIGINT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""
