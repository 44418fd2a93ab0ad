"""Token windows over one long corpus made of all documents in key order.

A token is a whitespace-separated word.  Documents get their global start position from a
two-level running sum over (key, token count); the texts move only once, to the windows that
need them.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ordering import running_sum



def words(text: Column) -> Column:
    """Tokens of a text: its items between single spaces after trimming."""
    return F.split(F.trim(text), " ")


def _sizes(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, n_tokens) per document: a few bytes each, kept so that the texts are read once for it."""
    return settle(docs.select(key, F.size(tokens).cast("long").alias("n_tokens")))


def with_offsets(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, n_tokens, start): where each document begins in the corpus."""
    return running_sum(_sizes(docs, key, tokens), key, F.col("n_tokens"), "start")


def _part(tokens: Column, start: Column, n_tokens: Column, low: Column, length: int) -> Column:
    """The tokens of a document inside the window that starts at ``low``."""
    first = F.greatest(low - start, F.lit(0)).cast("int")
    last = F.least(low + length - start, n_tokens).cast("int")
    return F.slice(tokens, first + 1, F.greatest(last - first, F.lit(0)))


def _assembled(pieces: DataFrame, length: int) -> DataFrame:
    """Windows put together from their pieces; a list holds at most ``length`` tokens."""
    part = F.struct("start", "piece")
    return (
        pieces.filter(F.size("piece") > 0)
        .groupBy("window")
        .agg(F.array_sort(F.collect_list(part)).alias("_parts"))
        .select("window", F.flatten("_parts.piece").alias("tokens"))
        .filter(F.size("tokens") == length)
    )


def consecutive_windows(docs: DataFrame, key: str, tokens: Column, length: int) -> DataFrame:
    """Non-overlapping windows of ``length`` tokens; an unfinished last one is dropped.

    A document is cut into its windows where it stands, so every token leaves it once.
    """
    offsets = with_offsets(docs, key, tokens).filter(F.col("n_tokens") > 0)
    placed = docs.select(key, tokens.alias("tokens")).join(offsets, key)
    start, n = F.col("start"), F.col("n_tokens")
    numbers = F.sequence(F.floor(start / length), F.floor((start + n - 1) / length))
    cut = F.transform(
        numbers,
        lambda w: F.struct(
            w.alias("window"), start.alias("start"), _part(F.col("tokens"), start, n, w * length, length).alias("piece")
        ),
    )
    return _assembled(placed.select(F.explode(cut).alias("p")).select("p.*"), length)


def window_starts(total: int, n: int, length: int, seed: int) -> list[int]:
    """Seeded start positions, uniform over the places where a whole window fits."""
    draw = random.Random(seed)
    return [draw.randint(0, total - length - 1) for _ in range(n)]


def corpus_tokens(docs: DataFrame, key: str, tokens: Column) -> int:
    """Number of tokens of the whole corpus."""
    return docs.agg(F.sum(F.size(tokens).cast("long"))).first()[0] or 0


def windows_at(docs: DataFrame, key: str, tokens: Column, windows: DataFrame, length: int) -> DataFrame:
    """The windows (``window``, ``low``) of ``length`` tokens, at any positions.

    Documents and windows meet on the cell of ``length`` tokens they touch, as numbers only; the texts
    are joined to the pairs that were found, and sliced before anything else moves.
    """
    offsets = with_offsets(docs, key, tokens).filter(F.col("n_tokens") > 0)
    low, high = F.col("low"), F.col("low") + length
    start, end = F.col("start"), F.col("start") + F.col("n_tokens")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / length), F.floor((b - 1) / length)))
    # A document that shares both cells of a window would come twice: keep its first cell there.
    first_shared = F.greatest(F.floor(low / length), F.floor(start / length))
    touching = (
        offsets.withColumn("cell", cells(start, end))
        .join(windows.select("window", "low").withColumn("cell", cells(low, high)), "cell")
        .filter((start < high) & (end > low) & (F.col("cell") == first_shared))
        .select(key, "start", "n_tokens", "window", "low")
    )
    own = docs.select(key, tokens.alias("tokens")).join(touching, key)
    part = _part(F.col("tokens"), start, F.col("n_tokens"), low, length)
    return _assembled(own.select("window", "start", part.alias("piece")), length)


def sample_windows(docs: DataFrame, key: str, tokens: Column, n: int, length: int, seed: int) -> DataFrame:
    """``n`` windows at seeded random positions of the corpus; the ``n`` starts are a parameter-sized table."""
    total = corpus_tokens(docs, key, tokens)
    if total <= length:
        raise ValueError(f"the corpus has {total} tokens, a window needs more than {length}")
    starts = list(enumerate(window_starts(total, n, length, seed)))
    windows = docs.sparkSession.createDataFrame(starts, "window long, low long")
    return windows_at(docs, key, tokens, windows, length)


def crop_documents(docs: DataFrame, key: str, tokens: Column, n: int, length: int, order: Column, offset: Column | None = None) -> DataFrame:
    """``n`` documents of at least ``length`` tokens in hash order, each cropped at a hashed place.

    The documents are chosen by key and order alone; only the chosen ones bring their tokens.
    """
    place = order if offset is None else offset
    thin = docs.select(key, F.size(tokens).alias("_n"), order.alias("_order"), place.alias("_place"))
    chosen = thin.filter(F.col("_n") >= length).orderBy("_order", key).limit(n)
    first = F.pmod(F.col("_place"), F.greatest(F.col("_n") - length, F.lit(1))).cast("int")
    own = docs.select(key, tokens.alias("tokens")).join(chosen, key)
    return own.select(key, F.slice("tokens", first + 1, F.lit(length)).alias("tokens"))


def corpus_head(docs: DataFrame, key: str, tokens: Column, n_docs: int, n_tokens: int) -> DataFrame:
    """The first ``n_tokens`` tokens of the first ``n_docs`` documents, one row per document."""
    head = with_offsets(docs, key, tokens).filter(F.col("start") < n_tokens).orderBy(key).limit(n_docs)
    kept = F.least(F.col("n_tokens"), F.lit(n_tokens) - F.col("start")).cast("int")
    own = docs.select(key, tokens.alias("tokens")).join(head, key)
    return own.select(key, "start", F.slice("tokens", F.lit(1), kept).alias("tokens"))
