"""Global positions and running sums without a single-partition window.

The key range is cut into buckets at approximate quantiles, as many as the rows are worth: one number for
a million rows of a large table.  They reach the plan as literals, so bucket numbers are the same in every run of every
branch.  Where the cuts fall changes only how even the buckets are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import let
from ..session import settle

#: Rows that a bucket is worth; the number of buckets follows the rows.
ROWS_PER_BUCKET = 20_000
ROWS_OF_LARGE = 1_000_000
#: Parts of a group that a sketch tells apart.
ACCURACY = 10_000
#: Cuts up to which a row is placed by one CASE tree; Java compiles no method much longer than that.
TREE = 64


def _quantiles(df: DataFrame, key: str, buckets: int | None) -> list:
    """Approximate quantiles of ``key``, smallest first, repeats kept.

    Unless a number of buckets is asked for, a small table has twice as many as shuffle partitions,
    but no more than its rows are worth or a tree holds, and a large one a bucket for each million rows.
    """
    if buckets is None:
        rows = df.agg(F.count(key)).first()[0]
        parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(2, min(parts, rows // ROWS_PER_BUCKET, TREE), rows // ROWS_OF_LARGE)
    most = max(2, buckets)
    shares = [i / most for i in range(1, most)]
    cuts = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * most))).first()[0]
    return cuts or []


def key_cuts(df: DataFrame, key: str, buckets: int | None = None) -> list:
    """Bucket borders of ``key``, smallest first (a bounded list on the driver)."""
    return sorted(set(_quantiles(df, key, buckets)))


def bucket_of(key: Column, cuts: list) -> Column:
    """Number of cuts at or below ``key``, by a balanced CASE tree, over blocks of cuts if there are many."""
    if not cuts:
        return F.lit(0)
    if len(cuts) > TREE:
        return _searched(key, cuts)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def _searched(key: Column, cuts: list) -> Column:
    """A tree finds the block of cuts, and only those of that block are compared one by one."""
    span = -(-len(cuts) // TREE)
    blocks = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + span]]) for i in range(0, len(cuts), span)])

    def inside(block):
        return block * span + F.size(F.filter(F.get(blocks, block), lambda cut: cut <= key))

    return let(bucket_of(key, cuts[span::span]), inside)


def running_sum(
    df: DataFrame, key: str, weight: Column, start: str, cuts: list | None = None, by=(),
    total: str | None = None,
) -> DataFrame:
    """Add ``start``: the sum of ``weight`` over all rows of the group with a smaller ``key``.

    ``key`` must be unique within its group; ``total`` names a column for the group's whole sum.
    Bucket totals give the offset of each bucket;
    inside a bucket an ordinary window does the rest.  Spark chooses the join by the size of the totals.
    """
    by = list(by)
    cuts = key_cuts(df, key) if cuts is None else cuts
    bucketed = df.withColumn("_bucket", bucket_of(F.col(key), cuts)).withColumn("_weight", weight)
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum("_weight").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_total").over(Window.partitionBy(*by)).alias(total)] if total else []
    offsets = totals.select(
        *by, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"), *whole
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(offsets, [*by, "_bucket"])
        .withColumn(start, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_weight", "_offset", "_inside")
    )


def exact_quantiles(df: DataFrame, value: str, shares, names, by=()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    A sketch brackets each quantile per group (a first scan).  A second scan counts what lies below a
    bracket, and how often each value inside it occurs; only these counts are kept and ranked, a few of
    ``ACCURACY`` parts of the rows, and a value that fills a third of the table is one row.  Groups
    that a sketch is too coarse for are their own brackets.  No task holds a group's values.
    """
    by = list(by)
    key = [*by, "_all"]
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(value).alias("_v"))
    margin = 4 / ACCURACY
    ends = [(max(0.0, s - margin), min(1.0, s + margin)) for s in shares]
    sketch = F.percentile_approx("_v", [e for pair in ends for e in pair], ACCURACY)
    sketched = rows.groupBy(*key).agg(
        F.count("*").alias("_size"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_near")
    )
    # The sketch may be off by a rank in ACCURACY, and both neighbours of a place have to be inside.
    coarse = F.col("_size") * F.lit(margin) < 4
    brackets = []
    for i, (low, high) in enumerate(ends):
        first, last = F.get("_near", F.lit(2 * i)), F.get("_near", F.lit(2 * i + 1))
        brackets.append(F.when(coarse | F.lit(low == 0), F.col("_least")).otherwise(first).alias(f"_lo{i}"))
        brackets.append(F.when(coarse | F.lit(high == 1), F.col("_most")).otherwise(last).alias(f"_hi{i}"))
    groups = settle(sketched.select(*key, "_size", *brackets))

    v = F.col("_v")
    spots = F.array(*[
        F.when(v <= F.col(f"_hi{i}"), F.struct(F.lit(i).alias("_want"), F.when(v >= F.col(f"_lo{i}"), v).alias("_at")))
        for i in range(len(ends))
    ])
    spotted = rows.join(groups, key).select(*key, F.inline(F.filter(spots, lambda spot: spot.isNotNull())))
    counts = settle(spotted.groupBy(*key, "_want", "_at").agg(F.count("*").alias("_n")))
    below = counts.filter("_at IS NULL").select(*key, "_want", F.col("_n").alias("_below"))
    inside = running_sum(counts.filter("_at IS NOT NULL"), "_at", F.col("_n"), "_start", by=[*key, "_want"])
    ranked = inside.join(below, [*key, "_want"], "left").join(groups.select(*key, "_size"), key)
    start = F.col("_start") + F.coalesce("_below", F.lit(0))

    def at(i, rank):
        here = (F.col("_want") == i) & (start <= rank) & (rank < start + F.col("_n"))
        return F.max(F.when(here, F.col("_at")))

    columns = []
    for i, (share, name) in enumerate(zip(shares, names)):
        place = F.lit(float(share)) * (F.col("_size") - 1)
        low, high = at(i, F.floor(place)), at(i, F.ceil(place))
        columns.append((low, high, F.max(place - F.floor(place)), name))
    table = ranked.groupBy(*by).agg(
        *[c.alias(f"{n}{part}") for lo, hi, fr, n in columns for c, part in ((lo, "_lo"), (hi, "_hi"), (fr, "_fr"))]
    )
    return table.select(
        *by,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_fr")).alias(n)
            for n in names
        ],
    )


def order_buckets(df: DataFrame, keys, buckets: int | None = None) -> list[Column]:
    """Bucket columns that follow the order of ``keys``, even where a value repeats very often.

    A value of the first key that holds more than a bucket's share of the rows (it shows up
    twice among the quantiles, so there are fewer of them than buckets) is cut further by the
    next key, and so on.  All lists on the driver are bounded by the number of buckets.
    """
    found = {(): _quantiles(df, keys[0], buckets)}
    shares = [i / 64 for i in range(1, 64)]
    columns = []
    for depth, key in enumerate(keys):
        column, hot = F.lit(0), []
        for path, cuts in found.items():
            inside = F.lit(True)
            for name, val in zip(keys, path):
                inside = inside & (F.col(name) == F.lit(val))
            # A bucket that starts with a hot value holds that value first, then larger ones.
            place = bucket_of(F.col(key), sorted(set(cuts))) * 2
            often = sorted({v for v in cuts if cuts.count(v) > 1})
            if often:
                place = place + F.when(F.col(key).isin(often), 0).otherwise(1)
            column = F.when(inside, place).otherwise(column) if path else place
            hot += [(*path, v) for v in often]
        columns.append(column.alias(f"_b{depth}"))
        if not hot or depth + 1 == len(keys):
            break
        used = list(keys[: depth + 1])
        wanted = F.lit(False)
        for path in hot:
            same = F.lit(True)
            for name, val in zip(used, path):
                same = same & (F.col(name) == F.lit(val))
            wanted = wanted | same
        rows = df.filter(wanted).groupBy(*used).agg(
            F.percentile_approx(keys[depth + 1], shares, 10000).alias("cuts")
        ).collect()
        found = {tuple(r[u] for u in used): r["cuts"] or [] for r in rows}
    return columns


def with_index(df: DataFrame, key: str, name: str = "idx", cuts: list | None = None) -> DataFrame:
    """Put a gap-free 0-based position by ``key`` in front, unless the column is there already."""
    if name in df.columns:
        return df
    numbered = running_sum(df, key, F.lit(1), name, cuts)
    return numbered.select(name, *df.columns)


def with_file_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Position by file and place in the file, for frames read straight from files.

    Parquet rows know their place in the file.  Other formats are numbered by the task that reads
    a split and kept, because splits may be cut differently when the files are read again.  The
    offsets are one row per file or split; their size decides how they are joined.
    """
    if name in df.columns:
        return df
    file = F.col("_metadata.file_path").alias("_file")
    if all(path.endswith(".parquet") for path in df.inputFiles()):
        split = ["_file"]
        placed = df.select("*", file, F.col("_metadata.row_index").alias("_at"))
        first = F.lit(0).cast("long")
    else:
        split = ["_file", "_block"]
        block = F.col("_metadata.file_block_start").alias("_block")
        placed = settle(
            df.select("*", file, block).withColumn("_at", F.monotonically_increasing_id())
        )
        first = F.min("_at")
    sizes = settle(placed.groupBy(*split).agg(first.alias("_first"), F.count("*").alias("_n")))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(offsets, split).select(
        (F.col("_offset") + F.col("_at") - F.col("_first")).cast("long").alias(name), *df.columns
    )


def take_slice(
    df: DataFrame, key: str, head: int = -1, start: int = 0, end: int = -1
) -> DataFrame:
    """First ``head`` rows by ``key``, then positions ``[start, end)``; -1 means all."""
    placed = with_index(df, key, "_position")
    keep = F.col("_position") >= start
    if head > 0:
        keep = keep & (F.col("_position") < head)
    if end != -1:
        keep = keep & (F.col("_position") < end)
    return placed.filter(keep).drop("_position")


def shuffle_key(key: str, seed: int) -> Column:
    """A reproducible random order of whole numbers: a seeded digest, the number itself for equal ones."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return (place + F.col(key).cast("decimal(18,0)")).cast("decimal(38,0)")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed))


def first_rows(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """At most ``n`` rows by ``key`` (none given: all); no task holds them all."""
    return df.orderBy(key) if not n else take_slice(df, key, head=n)
