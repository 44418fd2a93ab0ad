"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

Sets.  A document's set holds its distinct shingles of five words as 64-bit hashes.  Equal sets are
found first, by a 128-bit digest, and only one document of each (the smallest id) goes on.

Signatures.  SuperMinHash gives every element one random permutation of the positions, walked level
by level; position p takes the least of ``level + random``.  The levels end as soon as no later one
can lower any position, after a few for all but the shortest documents, and the correlated ranks
make the estimate less variable than independent hashes do.

Candidates.  Bands of 5 positions are hashed; in each bucket every member is paired with the bucket's
smallest id.  Pairs whose signatures agree too little are dropped (``near`` lies four standard
deviations below the threshold, whichever is asked for), the others are verified on the full sets.  Verified links are
grouped.  Where members of one bucket still belong to different groups, those that aren't in the
bucket's main group are compared with all members of other groups, in blocks, so that a link which the
first round did not try is found too.  Members with a likely partner in a block meet there again with their
full sets; pairs are verified on the spot, the likeliest first, and passed over once the block's links connect
them.  So a block gives fewer links than it has members, and no pair leaves it that isn't a link.

Grouping.  Each task turns its links into a forest by union-find.  A forest that fits one task
(``PER_TASK`` links) is united there; a larger one goes through rounds of large-star and small-star
steps, which bring every document to the smallest id it reaches, until nothing changes.

Skew.  Copies are gone before banding.  Bucket heads are an aggregate, combined before the shuffle.
In the second round large buckets are cut into blocks and dealt out by pairs of blocks; members of a
bucket's main group meet only blocks of other groups, so they are not copied where few others stand in
it.  Tasks are sized by the rows that are dealt.  Nothing is capped.

Defined results: a document without words has an empty set, is linked with nothing and stands alone;
one with fewer than five words has one shingle, the whole sequence.  Each row goes by its own text;
rows that repeat a doc_id are one node, so their texts share their links.  A null doc_id gets
n_shingles, a null component and is kept.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, stored

SHINGLE = 5
THRESHOLD = 85
BANDS, ROWS = 25, 5
POSITIONS = BANDS * ROWS
#: Positions that must agree before a pair is verified: so many standard deviations below the threshold.
SURE = 4
BLOCK = 1024
#: Rows that are compared in one call, many small buckets together.
TOGETHER = 8192
#: Bytes of sets and signatures that meet in one call.
BYTES = 48 << 20
#: Links that one task unites at the end; more of them are grouped by star steps between tasks.
PER_TASK = 500_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words))], np.uint64)
    tokens = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    mixed = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(mixed)])
    return np.unique(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(elements: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """SuperMinHash of a set that isn't empty: per position level and random bits of its least rank."""
    n = len(elements)
    least = np.full(positions, np.iinfo(np.uint64).max, np.uint64)
    order = np.broadcast_to(np.arange(positions, dtype=np.uint8), (n, positions)).copy()
    rows = np.arange(n)
    for level in range(positions):
        draw = _mix(elements + np.uint64((0xD1B54A32D192ED03 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = level + ((draw >> np.uint64(40)) % np.uint64(positions - level)).astype(np.int64)
        at = order[rows, swap]
        order[rows, swap] = order[:, level]
        rank = (np.uint64(level) << np.uint64(48)) | (draw & np.uint64((1 << 40) - 1))
        np.minimum.at(least, at, rank)
        if (least >> np.uint64(48)).max() <= level:
            break
    return least


def near(threshold: int) -> int:
    """Positions that agree at least where two sets reach the threshold (percent)."""
    share = threshold / 100
    return int(POSITIONS * (share - SURE * (share * (1 - share) / POSITIONS) ** 0.5))


#: Results of ``_least_agreeing`` so far; a plain dictionary, which is sent by value.
_KNOWN: dict[tuple[int, int], int] = {}


def _least_agreeing(power: int, threshold: int) -> int:
    """``near`` for unions of up to 2 ** (power / 4) elements, whose estimates vary less.

    The published variance of SuperMinHash is that of independent hashes times 1 minus the sum below.
    """
    if (power, threshold) in _KNOWN:
        return _KNOWN[power, threshold]
    m, u = POSITIONS, max(2.0, 2 ** (power / 4))
    at = np.arange(1.0, m)
    share = (at / m) ** u
    second = ((at + 1) / (m - 1)) ** u + ((at - 1) / (m - 1)) ** u - 2 * (at / (m - 1)) ** u
    less = float((share * second).sum() * (m - 1) / (u - 1))
    reached = threshold / 100
    deviation = (reached * (1 - reached) / m * max(0.0, 1 - less)) ** 0.5
    _KNOWN[power, threshold] = max(near(threshold), int(m * (reached - SURE * deviation)))
    return _KNOWN[power, threshold]


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest, bands (64-bit hashes) and marks (16 bits of every position, packed)."""

    @F.pandas_udf("n long, digest string, bands array<long>, marks binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                own = shingles(text)
                bands, marks = _signed(own) if len(own) else (None, None)
                rows.append((len(own), xxhash.xxh3_128_hexdigest(own.tobytes()), bands, marks))
            yield pd.DataFrame(rows, columns=["n", "digest", "bands", "marks"])

    return docs.select("doc_id", make("text").alias("s")).select("doc_id", "s.*")


def _signed(elements: np.ndarray) -> tuple[np.ndarray, bytes]:
    least = signature(elements)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64), _mix(least).astype("<u2").tobytes()


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n and the set itself, as sorted little-endian 64-bit hashes."""

    @F.pandas_udf("binary")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).astype("<u8").tobytes() for t in texts], dtype=object)

    sets = docs.select("doc_id", make("text").alias("shingles"))
    return sets.select("doc_id", F.expr("octet_length(shingles) div 8").cast("long").alias("n"), "shingles")


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    if a.empty:
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), POSITIONS) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two packed sets."""

    def count(x: bytes, y: bytes) -> int:
        both = np.sort(np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")]), kind="stable")
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([count(x, y) for x, y in zip(a, b)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    possible = pairs
    for side in "ab":
        own = sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("shingles").alias(f"s{side}"))
        possible = possible.join(own, side)
    shared = possible.withColumn("i", _shared("sa", "sb"))
    return shared.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * threshold).select("a", "b")


def _forest(links: DataFrame) -> DataFrame:
    """Union-find over the links of each task: (a, b) with b the root that the task finds for a."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in up if up[x] != x]
        for i in range(0, len(pairs), 10_000):
            yield pd.DataFrame(pairs[i : i + 10_000], columns=["a", "b"])

    return links.select("a", "b").mapInPandas(unite, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every document that has a link; the smallest id names the group.

    Union-find in each task leaves a forest; what fits a task is united there once more, which ends it.
    """
    links = stored(_forest(links), "links")
    if links.count() <= PER_TASK:
        return _named(stored(_forest(links.coalesce(1)), "links"))

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("m"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = state(links)
    while now[0]:
        # Large star: what is larger than a node goes to the least of its neighbourhood.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(heads, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: what is smaller, and the node itself, go to the least of them.
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(least(large), "a").select(ends, F.col("m").alias("b")).where("a <> b").distinct()
        links, before = stored(small, "links"), now
        now = state(links)
        if now == before:
            break
    return _named(links)


def _named(stars: DataFrame) -> DataFrame:
    """Components from links that all lead to the smallest id."""
    heads = stars.select(F.col("b").alias("doc_id")).distinct()
    return stars.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id")).unionByName(
        heads.withColumn("component_id", F.col("doc_id"))
    )


CELL = "key long, i int, j int, own int, doc_id long, n long, group long, band int, marks binary"


def _cells(members: DataFrame) -> tuple[DataFrame, int]:
    """Members of buckets with several groups, dealt out to pairs of blocks (key, i, j); and how many rows that makes."""
    groups = members.groupBy("key", "group").agg(F.count(F.lit(1)).alias("c"))
    largest = F.max(F.struct("c", "group"))
    counted = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("rows"), largest.alias("main"))
    # Blocks of members outside the main group, then those of the main group; a small bucket is one block.
    outside = F.col("rows") - F.col("main.c")
    blocks = lambda c: F.when(F.col("rows") > BLOCK, F.ceil(c / BLOCK))
    buckets = stored(
        counted.where("groups > 1").select(
            "key",
            F.col("main.group").alias("main"),
            F.coalesce(blocks(outside), F.lit(1)).cast("int").alias("few"),
            F.coalesce(blocks(F.col("main.c")), F.lit(0)).cast("int").alias("many"),
            outside.alias("outside"),
            F.col("main.c").alias("inside"),
        ),
        "mixed",
    )
    # Members of the main group meet the blocks of the others only; those meet all blocks.
    rows = buckets.agg(F.sum(F.col("outside") * (F.col("few") + F.col("many")) + F.col("inside") * F.col("few"))).first()[0]
    apart = (F.col("group") == F.col("main")) & (F.col("many") > 0)
    number = F.xxhash64("doc_id")
    own = F.when(apart, F.col("few") + F.pmod(number, F.col("many"))).otherwise(F.pmod(number, F.col("few"))).cast("int")
    last = F.when(apart, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    blocked = members.join(buckets, "key").withColumn("own", own)
    sides = F.explode(F.sequence(F.lit(0), last)).alias("other")
    return blocked.select("*", sides).select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        *(c.split()[0] for c in CELL.split(", ")[3:]),
    ), rows or 0


def _each_cell(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each cell; small groups come first, so the largest one is never taken up by itself."""
    size = pdf.groupby(["key", "i", "j", "group"])["doc_id"].transform("size")
    pdf = pdf.assign(size=size).sort_values(["key", "i", "j", "size", "group", "doc_id"], kind="stable")
    key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
    new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for a, b in zip(np.r_[0, new], np.r_[new, len(pdf)]):
        if b > a:
            yield pdf.iloc[a:b]


def _likely(cell: pd.DataFrame, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places in a cell with those behind them, in other groups, whose signatures agree enough; the best first.

    A pair is given by the first band in which it agrees alone.
    """
    marks = np.frombuffer(b"".join(cell["marks"]), "<u2").reshape(len(cell), POSITIONS)
    group, own, n = (cell[c].to_numpy() for c in ("group", "own", "n"))
    apart, band = cell["i"].iat[0] != cell["j"].iat[0], int(cell["band"].iat[0])
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    ends = np.repeat(ends, np.diff(np.r_[0, ends]))
    for x in range(int(ends.searchsorted(len(group)))):
        others = np.arange(ends[x], len(group))
        close = 100 * np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x])
        if apart:
            close &= own[others] != own[x]
        others = others[close]
        if not len(others):
            continue
        same = marks[others] == marks[x]
        agreeing = same.sum(axis=1)
        # At the threshold the union has (a + b) / (1 + threshold) elements.
        union = (n[x] + n[others].max()) / (1 + threshold / 100)
        close = agreeing >= _least_agreeing(int(np.ceil(4 * np.log2(union + 1))), threshold)
        if band and close.any():
            close[close] = ~same[close, : band * ROWS].reshape(-1, band, ROWS).all(axis=2).any(axis=1)
        if close.any():
            yield x, others[close][np.argsort(-agreeing[close], kind="stable")]


def _across(members: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Verified links (a, b) that connect what belongs together in buckets whose members stand in several groups.

    ``members`` has key, band, doc_id, n, group and marks.  Signatures tell which members have a likely partner
    in a cell; only these meet there again with their full sets.  A pair that the cell's links connect already is
    passed over, so a cell gives fewer links than it has members.
    """
    dealt, rows = _cells(members)

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pdf[:0]]
        for cell in _each_cell(pdf):
            mark = np.zeros(len(cell), bool)
            for x, others in _likely(cell, threshold):
                mark[x] = True
                mark[others] = True
            found.append(cell[mark])
        return pd.concat(found)[[c.split()[0] for c in CELL.split(", ")]]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for cell in _each_cell(pdf):
            ids, group = (cell[c].tolist() for c in ("doc_id", "group"))
            own = [np.frombuffer(x, "<u8") for x in cell["shingles"]]
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for x, others in _likely(cell, threshold):
                for y in others.tolist():
                    a, b = root(group[x]), root(group[y])
                    if a != b and _reach(own[x], own[y], threshold):
                        up[max(a, b)] = min(a, b)
                        found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def shard(count: int) -> Column:
        return F.pmod(F.xxhash64("key", "i", "j"), F.lit(count + 1)).alias("shard")

    partners = stored(dealt.select("*", shard(rows // TOGETHER)).groupBy("shard").applyInPandas(likely, CELL), "partners")
    size = partners.agg(F.sum(8 * F.col("n") + 2 * POSITIONS)).first()[0] or 0
    whole = partners.join(sets.select("doc_id", "shingles"), "doc_id")
    return whole.select("*", shard(size // BYTES)).groupBy("shard").applyInPandas(verify, "a long, b long")


def _reach(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have the threshold's share of their union in common."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def grouped(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    every = stored(prepared(in_small_batches(docs)), "signatures")
    thin = every.select("doc_id", "n", "digest")
    marks = stored(
        every.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")),
        "heads",
    )
    heads = marks.select("digest", F.col("doc_id").alias("head"))

    keys = marks.select("doc_id", F.posexplode("bands").alias("band", "key"))
    first = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stored(keys.join(first.select("key", "a"), "key"), "buckets")
    pairs = shared.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    x, y = (marks.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}")) for c in "ab")
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    likely = pairs.join(x, "a").join(y, "b").where(sizes).where(_agreeing("ma", "mb") >= near(threshold)).select("a", "b")
    inside = shared.select("doc_id").distinct()
    own = stored(packed_sets(docs.select("doc_id", "text").join(inside, "doc_id", "left_semi")), "sets")
    links = _verified(likely, own, threshold)
    found = components(links)
    members = (
        shared.join(found, "doc_id", "left")
        .join(marks.select("doc_id", "n", "marks"), "doc_id")
        .select("key", "band", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("group"), "marks")
    )
    known = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    found = components(known.unionAll(_across(members, own, threshold)))

    of_head = heads.join(found, F.col("head") == F.col("doc_id"), "left").select(
        F.col("digest").alias("__digest"), F.coalesce("component_id", "head").alias("group")
    )
    # Documents without words have no head; those without an id are never one.
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    named = thin.join(of_head, F.col("digest") == F.col("__digest"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id")
    )
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest id, and one row of it.

    Rows without an id stay.
    """
    gone = grouped(docs, threshold).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    rest = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    number = F.row_number().over(W.partitionBy(own).orderBy(own))
    return rest.withColumn("__row", number).where("__row = 1 OR doc_id IS NULL").drop("__row")
