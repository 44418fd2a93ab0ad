"""Near-duplicate documents: SimHash fingerprints, found by fuzzy hashing with the Golay code.

Fingerprints.  A text's three-word shingles are hashed with repeats (XXH64, seed 42); a bit of the
fingerprint is 1 if it is set in over half of the hashes.

Keys.  The binary Golay code has 23 bits, and every 23-bit word lies within three bits of exactly one of
its 4,096 codewords.  A fingerprint is cut into three segments (22, 21 and 21 bits, filled up with
zeros).  The keys of a segment are the indices of the codewords to which the segment and all segments one
bit away decode: one key or a few, up to six.  Two segments that differ in two bits have the segment
half-way between in common, so they share a key; so do those that differ in fewer.

Pigeonhole.  Of two differing bits some segment has none, and of the two others at most one has two.  A
key of a fingerprint is therefore one segment's bits together with a codeword index of the next segment:
if one segment holds both errors, the other two agree, and one of them is next to the other in the ring of
three; if two segments hold one each, the third one agrees, and the next one is a bit away.

Join and verification.  Distinct fingerprints (copies are merged first) meet in the buckets of their keys,
each pair is verified by its differing bits, and a task gives back a forest: fewer links than it has
members.  A bucket of more than ``BUCKET`` fingerprints is taken apart: its members go on with 65 keys
each, themselves and all words one bit away.  Two fingerprints within two bits share such a word, all
members of its bucket are within two bits of one another, and there are 65 at most, so a link from each
to the smallest is exact, and an aggregate gives it.

Defined results: a text without words (null, empty, blank) has fingerprint zero, which is linked like any
other; texts are taken whole.  Each row has its own text's fingerprint; rows that repeat a doc_id are one
node, so their texts share their links.  A row without an id gets its fingerprint and a null component,
and links nothing.  An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, stored
from .minhash import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members up to which the pairs of a bucket are compared; larger ones are taken apart.
BUCKET = 128
#: Rows that are compared in one call, many small buckets together.
TOGETHER = 50_000
#: Shingles that are hashed before their bits are counted.
AT_ONCE = 1 << 16
#: Generator polynomial of the Golay code.
GENERATOR = 0xC75


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text's three-word shingles, bits counted ``AT_ONCE`` shingles at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, AT_ONCE):
        part = words[start : start + AT_ONCE + SHINGLE - 1]
        runs = map(b" ".join, zip(part, part[1:], part[2:]))
        hashes = np.fromiter(map(digest, runs, itertools.repeat(SEED)), "<u8", len(part) - SHINGLE + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint's 64 bits as a long) of every row."""

    @F.pandas_udf(T.LongType())
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", make("text").alias("print"))


def _remainders() -> np.ndarray:
    """Remainder of every power of x up to 22 by the generator: the check bits of a single error."""
    out = np.zeros(23, np.int64)
    value = 1
    for bit in range(23):
        out[bit] = value
        value <<= 1
        if value >> 11:
            value ^= GENERATOR
    return out


def golay_tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Check bits by byte of a word, check bits of single bits, and the error that each remainder stands for.

    The 2,048 patterns of up to three errors have all the 2,048 remainders between them.
    """
    single = _remainders()
    by_byte = []
    for first in (0, 8, 16):
        table = np.zeros(256, np.int64)
        for bit in range(min(8, 23 - first)):
            table[(np.arange(256) >> bit & 1) == 1] ^= single[first + bit]
        by_byte.append(table)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    return by_byte, single, errors


def segment_keys(words: np.ndarray, width: int, tables: tuple) -> np.ndarray:
    """Codeword indices of each word and of all words one bit away; a row has ``width`` + 1 of them, with repeats."""
    by_byte, single, errors = tables
    check = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    flips = np.r_[0, 1 << np.arange(width)]
    near = words[:, None] ^ flips
    return (near ^ errors[check[:, None] ^ np.r_[0, single[:width]]]) >> 11


def keys(prints: np.ndarray, tables: tuple) -> list[np.ndarray]:
    """Distinct keys of each fingerprint: which segment agrees, its bits, a codeword index of the next one."""
    bits = prints.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    out = []
    for i, agreeing in enumerate(parts):
        after = (i + 1) % len(parts)
        index = segment_keys(parts[after], SEGMENTS[after][1], tables)
        out.append((i << 40 | agreeing << 12)[:, None] | index)
    every = np.sort(np.concatenate(out, axis=1), axis=1)
    first = np.ones(every.shape, bool)
    first[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.split(every[first], np.cumsum(first.sum(axis=1))[:-1])


def _keyed(prints: DataFrame) -> DataFrame:
    """A row for each key of each distinct fingerprint: key, print."""
    tables = golay_tables()

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(keys(batch.to_numpy("int64"), tables) if len(batch) else [], dtype=object)

    return prints.select("print", F.explode(make("print")).alias("key")).select("key", "print")


def _close_pairs(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with one key (rows are sorted by it) that differ in no more than ``DISTANCE`` bits."""
    left, right = [], []
    at = np.arange(len(key) - 1)
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        close = np.bitwise_count(prints[at] ^ prints[at + step]) <= DISTANCE
        left.append(at[close])
        right.append(at[close] + step)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _united(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest of the pairs: each member with the root that union-find gives it."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if up[x] != x]


def _compared(members: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between the fingerprints of each bucket: a forest of each task's verified pairs."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key, prints = pdf["key"].to_numpy(), pdf["print"].to_numpy("int64")
        order = np.argsort(key, kind="stable")
        prints = prints[order]
        x, y = _close_pairs(key[order], prints.view(np.uint64))
        return pd.DataFrame(_united(zip(prints[x].tolist(), prints[y].tolist())), columns=["a", "b"], dtype="int64")

    shard = F.pmod(F.xxhash64("key"), F.lit(rows // TOGETHER + 1))
    return members.withColumn("shard", shard).groupBy("shard").applyInPandas(compare, "a long, b long")


def _taken_apart(prints: DataFrame) -> DataFrame:
    """Exact links (a, b) of the fingerprints within two bits, by the words half-way between."""
    around = F.array(F.col("print"), *(F.col("print").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    spread = prints.select("print", F.explode(around).alias("word"))
    least = spread.groupBy("word").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = spread.join(least.select("word", "a"), "word").where("print <> a")
    return met.select(F.col("print").alias("a"), F.col("a").alias("b")).distinct()


def linked(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (``print``) within ``DISTANCE`` bits of one another."""
    keyed = _keyed(prints)
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "simhash-buckets")
    total = sizes.agg(F.sum(F.when(F.col("c") <= bucket, F.col("c")))).first()[0] or 0
    members = keyed.join(sizes.where(F.col("c") <= bucket).select("key"), "key")
    large = keyed.join(sizes.where(F.col("c") > bucket).select("key"), "key").select("print").distinct()
    return _compared(members, total).unionByName(_taken_apart(large))


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def grouped(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    every = stored(fingerprints(in_small_batches(docs)), "simhash-prints")
    known = every.where("doc_id IS NOT NULL")
    heads = stored(known.groupBy("print").agg(F.min("doc_id").alias("head")), "simhash-heads")
    found = stored(linked(heads.select("print"), bucket), "simhash-links")
    of = lambda side: heads.select(F.col("print").alias(side), F.col("head").alias(f"{side}_head"))
    links = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    # Rows that repeat an id with different texts: their fingerprints' heads belong together.
    least, most = F.min("print").alias("least"), F.max("print").alias("most")
    several = known.groupBy("doc_id").agg(least, most).where("least <> most").select("doc_id", "least")
    own = known.join(several, "doc_id").where("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b"))
    again = own.distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    named = components(links.unionByName(again).where("a <> b"))
    of_print = heads.join(named, F.col("head") == F.col("doc_id"), "left").select(
        F.col("print").alias("own_print"), F.coalesce("component_id", "head").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return every.join(of_print, F.col("print") == F.col("own_print"), "left").select(
        "doc_id", hexadecimal(F.col("print")).alias("fingerprint"), component.alias("component_id")
    )
