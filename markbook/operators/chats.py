"""Training records from chats: role tags, rendering, cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import settle


def chat_records(turns: DataFrame, tags: dict[str, str], by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation: ``conversations`` as (from, value) in turn order.

    ``tags`` names the record's tag for each role; turns with another role are left out.
    """
    tag = F.coalesce(*[F.when(F.col(role) == name, F.lit(tagged)) for name, tagged in tags.items()])
    turn = F.struct(F.col(order).alias("at"), F.col("_tag").alias("from"), F.col(text).alias("value"))
    said = turns.withColumn("_tag", tag).filter(F.col("_tag").isNotNull())
    lists = said.groupBy(by).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return lists.select(by, F.transform("t", lambda x: F.struct(x["from"], x["value"])).alias("conversations"))


def rendered(conversations: Column, tags: dict[str, str], system: str | None = None) -> Column:
    """A record in chat markup, one block a turn; ``tags`` maps the record's tags to role names.

    Without a system turn of its own it gets ``system``, if one is given.
    """
    role = lambda x: F.coalesce(*[F.when(x["from"] == tag, F.lit(name)) for tag, name in tags.items()], x["from"])
    block = lambda name, value: F.concat(F.lit(V.CHAT_START), name, F.lit("\n"), value, F.lit(V.CHAT_END), F.lit("\n"))
    turns = F.array_join(F.transform(conversations, lambda x: block(role(x), F.coalesce(x["value"], F.lit("")))), "")
    if system is None:
        return turns
    own = F.exists(conversations, lambda x: role(x) == "system")
    return F.concat(F.when(own, "").otherwise(block(F.lit("system"), F.lit(system))), turns)


def cut_off(tokens: Column, limit: int) -> Column:
    """(tokens, was_cut): at most ``limit`` tokens of a record."""
    return F.struct(F.slice(tokens, 1, limit).alias("tokens"), (F.size(tokens) > limit).alias("was_cut"))


def fill_bins(sizes: list[int], budget: int) -> list[int]:
    """A bin's number for every size: the longest first, each into the bin with the least room that will do.

    Bins are found by their room, of which one integer keeps a bit each, not by looking through them.  A size
    over the budget, or of all of it, fills a bin alone.
    """
    by_room: list[list[int]] = [[] for _ in range(budget + 1)]
    rooms = bins = 0
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        fitting = rooms >> size << size
        if size <= budget and fitting:
            room = (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, number, bins = max(budget, size), bins, bins + 1
        out[at] = number
        left = room - size
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return out


def packed(records: DataFrame, key: str, tokens: str, budget: int, group: int = 4096) -> DataFrame:
    """Adds ``bin``: records that share a bin hold at most ``budget`` tokens together.

    Records are dealt into groups of about ``group`` budgets, and each group is filled by itself, so no
    task grows with the table.  What groups leave in bins up to half full is dealt and filled once more.  A
    record longer than the budget gets a bin of its own.  Every row is packed for itself, also where a
    ``key`` occurs again; a missing size counts as nothing.
    """
    size = F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    rows = settle(records.withColumn("_row", F.monotonically_increasing_id()))
    schema = "item long, held long, bin string"

    def fill(pdf):
        bins = fill_bins(pdf["held"].tolist(), budget)
        return pdf.assign(bin=[f"{name}-{b}" for name, b in zip(pdf["_g"], bins)])[["item", "held", "bin"]]

    def dealt(items: DataFrame, name: str) -> DataFrame:
        groups = items.agg(F.ceil(F.sum("held") / F.lit(budget * group))).first()[0] or 1
        number = F.pmod(F.xxhash64("item"), F.lit(int(groups))).cast("string")
        named = items.withColumn("_g", F.concat(F.lit(name), number))
        return settle(named.groupBy("_g").applyInPandas(fill, schema))

    first = dealt(rows.select(F.col("_row").alias("item"), size.alias("held")), "a")
    held = first.groupBy("bin").agg(F.sum("held").alias("held"), F.min("item").alias("item"))
    again = dealt(held.filter(F.col("held") * 2 <= budget).select("item", "held"), "b")
    moved = held.join(again.select("item", F.col("bin").alias("_to")), "item").select("bin", "_to")
    final = first.join(moved, "bin", "left").select(F.col("item").alias("_row"), F.coalesce("_to", "bin").alias("bin"))
    return rows.drop("bin").join(final, "_row").drop("_row")
