"""Language-model scores from a probabilistic suffix tree.

Symbols are words, lower-cased in A-Z, and one end per text.  The tree's states are contexts of up to
``DEPTH`` words.  A context is looked at if it occurs ``MIN_CONTEXT`` times in training text, and
becomes a state if predicting what follows it from its own counts, rather than from the context without
its oldest word, gains ``MIN_GAIN`` nats over its occurrences (the divergence between both
distributions times the count).  The distribution of a state keeps symbols seen ``MIN_PAIR`` times, less
a discount, and leaves the rest to the next shorter state:

    P(x | s) = max(c(s, x) - D, 0) / c(s) + left(s) * P(x | shorter s)

down to the smoothed unigram (c(x) + 0.5) / (N + 0.5 (V + 1)).  A text is scored token by token from the
longest suffix of its past that is a state.

Data flow.  Texts are encoded once, in chunks: a chunk's own vocabulary as 64-bit hashes and its
documents as numbers into it.  For each depth a chunk sends the contexts and symbols it holds, each pair
once, with its own training counts; the counts are summed up by pair, and the chunk is answered with the
sums.  For the states it asks once more.  All of this travels packed, one row for a chunk and a range of
keys; there are as many ranges as keep one at about ``RANGE`` tokens' keys.  Keys are sorted and sent as
differences.  Pairs go by ranges of the context, so a chunk names a context once, and by ranges of the
symbol for contexts that alone would fill an eighth of one.  The more ranges there are, the more often a
chunk names a symbol, so frequent words (``LISTED``) go as numbers into a list that all tasks have; others
go as keys.  Answers are values in the order of the question, without its keys: the chunk makes its
questions again.  No part of the model is broadcast but fixed-size bitmaps (``BITS``) of the keys worth
asking for, where more keys are asked for as they fill up, that list, and the contexts above, fewer than
eight to a range.

Defined results: null and empty texts consist of the end alone; a null doc_id neither trains nor is held
out (held_out is null); repeated rows count and are scored each by itself; without training text N is 0
and every token has the probability of the one unknown symbol; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, in_small_batches, stored

DEPTH = 2
MIN_CONTEXT = 64
MIN_NEXT = 4
MIN_PAIR = 3
MIN_GAIN = 12.0
DISCOUNT = 0.75
#: Tokens after which a chunk ends.
CHUNK = 3_000_000
#: Tokens to a range of keys.
RANGE = 8_000_000
#: Size of a bitmap, and the shifts that give a key its bits in it.
BITS = 1 << 26
SHIFTS = (0, 26)
#: Most words in the list of frequent ones.
LISTED = 1 << 20
#: Tokens whose contexts a worker holds and counts at a time.
SLICE = 500_000
TURN = 21
END = np.uint64(0x9AE16A3B2F90404F)
STATE = np.uint64(0x5851F42D4C957F2D)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def joined(newer: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Key of a symbol after a context; also the key of the context that both make up."""
    return newer ^ (older << np.uint64(TURN) | older >> np.uint64(64 - TURN))


def joined_column(newer: str, older: str) -> Column:
    turned = F.shiftleft(older, TURN).bitwiseOR(F.shiftrightunsigned(older, 64 - TURN))
    return F.col(newer).bitwiseXOR(turned)


def _signed(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.int64)


def _pack(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order, as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _pack_numbers(x: np.ndarray) -> list[bytes]:
    """Numbers of which small ones are frequent: how many bits each has, then the numbers by that."""
    bits = np.empty(len(x), np.uint8)
    for i in range(0, len(x), SLICE):
        bits[i : i + SLICE] = np.frexp(x[i : i + SLICE] + 1.0)[1]
    return [_pack(bits), _pack(x[np.argsort(bits, kind="stable")])]


def _unpack_numbers(bits: bytes, numbers: bytes) -> np.ndarray:
    order = np.argsort(_unpack(bits, "u1"), kind="stable")
    x = np.empty(len(order), np.int32)
    x[order] = _unpack(numbers, "<i4")
    return x


def _first_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _ends(ranges: np.ndarray, bits: int) -> np.ndarray:
    """Where each range ends in ascending numbers of ranges; from 0, the start of the first one."""
    return np.searchsorted(ranges, np.arange((1 << bits) + 1))


def _summed(c: np.ndarray, *keys: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows of the keys, sorted by the first, then the next, and the sums of ``c``.

    Or in the given order, in which rows that aren't neighbours stay apart.
    """
    order = np.lexsort(keys[::-1]) if order is None else order
    keys, c = [k[order] for k in keys], c[order]
    new = np.ones(len(c), bool)
    if len(c):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return np.add.reduceat(c, first) if len(c) else c, *(k[first] for k in keys)


CHUNKS = "chunk long, size long, doc_ids array<long>, trained array<boolean>, lengths binary, bits binary, tokens binary, vocabulary binary"


def chunked(docs: DataFrame) -> DataFrame:
    """One row a chunk; a chunk holds neighbouring documents of one task."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        ids, trained, lengths, parts, total = [], [], [], [], 0
        known: dict[bytes, int] = {}

        def row() -> pd.DataFrame:
            tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
            # Frequent words get small numbers, which pack well; between powers of two they go by hash.
            rank = np.empty(len(known), np.int32)
            rank[np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")] = np.arange(len(known), dtype=np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            order = np.lexsort((hashes, np.frexp(rank + 1.0)[1]))
            rank[order] = np.arange(len(known), dtype=np.int32)
            packed = [_pack(np.array(lengths, np.int32)), *_pack_numbers(rank[tokens]), _pack_keys(hashes[order])]
            columns = ["chunk", "size", "doc_ids", "trained", "lengths", "bits", "tokens", "vocabulary"]
            return pd.DataFrame([[chunk, total, ids, trained, *packed]], columns=columns)

        for pdf in batches:
            for doc_id, text, train in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["train"].tolist()):
                found = words(text)
                parts.append(np.array([known.setdefault(w, len(known)) for w in found], np.int32))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                trained.append(bool(train))
                lengths.append(len(found))
                total += len(found) + 1
                if total >= CHUNK:
                    yield row()
                    chunk += 1
                    ids, trained, lengths, parts, total, known = [], [], [], [], 0, {}
        if ids:
            yield row()

    train = F.coalesce(fold() != 1, F.lit(False)).alias("train")
    return in_small_batches(docs).select("doc_id", "text", train).mapInPandas(encode, CHUNKS)


class Chunk:
    """A chunk's tokens with the end of each document, and the keys of their contexts."""

    def __init__(self, row) -> None:
        self.number, self.doc_ids, self.trained = row.chunk, row.doc_ids, np.array(row.trained, bool)
        self.vocabulary = np.concatenate([_unpack_keys(row.vocabulary), [END]])
        lengths = _unpack(row.lengths, "<i4").astype(np.int64)
        tokens = _unpack_numbers(row.bits, row.tokens)
        self.ends = np.cumsum(lengths + 1) - 1
        self.tokens = np.full(len(tokens) + len(lengths), len(self.vocabulary) - 1, np.int32)
        inside = np.ones(len(self.tokens), bool)
        inside[self.ends] = False
        self.tokens[inside] = tokens
        self.counts = lengths + 1
        starts = (self.ends - lengths).astype(np.int32)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(starts, self.counts)
        self.in_training = np.repeat(self.trained, self.counts)

    def contexts(self, depth: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, context) of tokens with ``depth`` words before them.

        Some at a time; of the tokens in the mask ``wanted`` only, if one is given.
        """
        for i in range(0, len(self.place), SLICE):
            known = self.place[i : i + SLICE] >= depth
            at = np.flatnonzero(known if wanted is None else known & wanted[i : i + SLICE])
            at += i
            yield at, self.context(at, depth)

    def context(self, at: np.ndarray, depth: int) -> np.ndarray:
        context = self._keys(at - depth)
        for back in range(depth - 1, 0, -1):
            context = joined(self._keys(at - back), context)
        return context

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return self.vocabulary[self.tokens[at]]


class Places:
    """Where keys are in an ascending array of them; its length for those it lacks.

    Keys are hashes, so few share their first bits.
    """

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = np.r_[keys, np.uint64(0)], np.uint64(64 - bits)
        ends = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))
        self.starts = np.r_[0, ends].astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        first = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        places = np.full(len(keys), len(self.keys) - 1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            places[left[hit]] = at[left[hit]]
            at[left] += 1
            left = left[~hit & (at[left] < end[left])]
        return places


class Bitmap:
    """Which keys are worth asking for; may say yes to others."""

    def __init__(self, packed: bytes) -> None:
        self.bits = _unpack(packed, "u1")

    def of(self, keys: np.ndarray) -> np.ndarray:
        yes = np.ones(len(keys), bool)
        for shift in SHIFTS:
            at = (keys >> np.uint64(shift) & np.uint64(BITS - 1)).astype(np.int64)
            yes &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return yes


def bitmap(keys: DataFrame):
    """Broadcast bitmap of the column ``key``: BITS / 8 bytes at most, whatever the number of keys."""
    # Both functions count from 1.
    places = F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(BITS - 1)) + 1 for shift in SHIFTS])
    place = F.col("place")
    # Each task makes a bitmap of its own, so there should be few where there are few keys.
    few = keys.count() // 5_000_000 + 1
    parts = (
        keys.coalesce(few).select(F.explode(places).alias("place"))
        .select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for bucket, data in parts.collect():
        bits[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(data)] = np.frombuffer(data, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(_pack(bits))


def frequent(counts: DataFrame):
    """Broadcast keys of the most frequent words that may be asked for, in ascending order; LISTED at most.

    Words of about the same count are in it together or not at all.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    counts = counts.where(F.col("c") >= MIN_NEXT).withColumn("level", level)
    levels = counts.groupBy("level").count().orderBy(F.desc("level")).collect()
    sizes = np.cumsum([r["count"] for r in levels])
    taken = [r["level"] for r, size in zip(levels, sizes) if size <= LISTED]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = [pdf["key"].to_numpy(np.int64).view(np.uint64) for pdf in batches]
        if keys:
            yield pd.DataFrame({"keys": [_pack_keys(np.sort(np.concatenate(keys)))]})

    parts = counts.where(F.col("level").isin(taken)).select("key").mapInPandas(pack, "keys binary").collect()
    keys = np.concatenate([np.empty(0, np.uint64), *(_unpack_keys(r["keys"]) for r in parts)])
    return counts.sparkSession.sparkContext.broadcast(_pack_keys(np.sort(keys)))


def _pack_words(keys: np.ndarray, listed: Places) -> list[bytes]:
    """Keys in ascending order: the numbers of those in the list, and the others."""
    at = listed.of(keys)
    known = at < len(listed.keys) - 1
    return [_pack(np.diff(at[known], prepend=np.int32(0))), _pack_keys(keys[~known])]


def _unpack_words(numbers: bytes, others: bytes, listed: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([listed[np.cumsum(_unpack(numbers, "<i4"))], _unpack_keys(others)]))


def _pairs(chunk: Chunk, depth: int, gates: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, s, c): symbols of a chunk after its contexts of a depth, and how often in training.

    Those that the bitmaps name, of contexts, of symbols and of the pairs with the shorter context; at
    depth 0 all words, with 0 as their context.
    """
    if not depth:
        c = np.bincount(chunk.tokens[chunk.in_training], minlength=len(chunk.vocabulary))
        return chunk.vocabulary, np.zeros(len(c), np.uint64), c
    near, worth, *lower = gates
    parts = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64))]
    for at, context in chunk.contexts(depth, worth.of(chunk.vocabulary)[chunk.tokens]):
        k = near.of(context)
        at, context = at[k], context[k]
        for shorter in lower:
            k = shorter.of(joined(chunk._keys(at), chunk.context(at, depth - 1)))
            at, context = at[k], context[k]
        # Equal pairs become neighbours by one key, which is faster; ``ranged`` sorts them.
        order = np.argsort(joined(chunk._keys(at), context))
        c, x, s = _summed(chunk.in_training[at].astype(np.int32), chunk.tokens[at], context, order=order)
        parts.append((c.astype(np.int32), x, s))
    # Lists go one by one, which takes less memory.
    c, x, s = map(list, zip(*parts))
    del parts
    c, s = np.concatenate(c), np.concatenate(s)
    return chunk.vocabulary[np.concatenate(x)], s, c


def ranged(
    x: np.ndarray, s: np.ndarray, c: np.ndarray, often: np.ndarray, bits: int, by_context: bool = False
) -> tuple[np.ndarray, ...]:
    """(x, s, c) by range, symbol and context, each pair once, and where the ranges end.

    Ranges are of symbols or of contexts, and of the others for those in ``often``.
    """
    own, other = (s, x) if by_context else (x, s)
    spread = Places(np.sort(often)).of(own) < len(often)
    # Numbers of 16 bits are sorted fast.
    ranges = _first_bits(np.where(spread, other, own), bits).astype(np.uint16 if bits <= 16 else np.int32)
    order = np.argsort(ranges, kind="stable").astype(np.int32)
    ends = _ends(ranges[order], bits)
    new_x, new_s, new_c, new_ends = np.empty_like(x), np.empty_like(s), np.empty(len(c), np.int64), [0]
    # One range is sorted at a time, which takes less memory.
    for i, j in zip(ends, ends[1:]):
        k = order[i:j]
        found = _summed(c[k], x[k], s[k])
        i, j = new_ends[-1], new_ends[-1] + len(found[0])
        new_c[i:j], new_x[i:j], new_s[i:j] = found
        new_ends.append(j)
    return new_x[:j], new_s[:j], new_c[:j], np.array(new_ends)


PACKED = ["symbols", "rare_symbols", "sizes", "contexts", "rare_contexts", "places", "c"]
PAIRS = ", ".join(["range int", *(f"{x} binary" for x in PACKED)])
NONE = np.empty(0, np.uint64)


def packed_pairs(x: np.ndarray, s: np.ndarray, c: np.ndarray, ends: np.ndarray, listed: np.ndarray = NONE) -> pd.DataFrame:
    """One row a range: each symbol once, its contexts as places among those of the range, and the counts."""
    found, listed = [], Places(listed)
    for r, (i, j) in enumerate(zip(ends, ends[1:])):
        if i < j:
            symbols, sizes = np.unique(x[i:j], return_counts=True)
            contexts, places = np.unique(s[i:j], return_inverse=True)
            sizes, places = (_pack(y.astype(np.int32)) for y in (sizes, places))
            found.append((r, *_pack_words(symbols, listed), sizes, *_pack_words(contexts, listed), places, _pack(c[i:j])))
    return pd.DataFrame(found, columns=["range", *PACKED])


def unpacked_pairs(row, listed: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.repeat(_unpack_words(row.symbols, row.rare_symbols, listed), _unpack(row.sizes, "<i4"))
    contexts = _unpack_words(row.contexts, row.rare_contexts, listed)
    return x, contexts[_unpack(row.places, "<i4")], _unpack(row.c, "<i8")


def followers(
    chunks: DataFrame, depth: int, gates: tuple, often: np.ndarray, bits: int, listed=None
) -> tuple[DataFrame, DataFrame]:
    """(s, x, c): training counts of symbols after contexts; (depth, range, chunk, c): a chunk's share of them.

    ``listed`` is what ``frequent`` gives, or None.
    """
    least = MIN_PAIR if depth else 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps, frequent = tuple(Bitmap(g.value) for g in gates), _unpack_keys(listed.value) if listed else NONE
        for pdf in batches:
            for row in pdf.itertuples():
                own = ranged(*_pairs(Chunk(row), depth, maps), often, bits, depth > 0)
                yield packed_pairs(*own, frequent).assign(chunk=row.chunk)

    def total(asked: pd.DataFrame) -> pd.DataFrame:
        frequent = _unpack_keys(listed.value) if listed else NONE
        parts = [unpacked_pairs(row, frequent) for row in asked.itertuples()]
        sizes = [len(p[2]) for p in parts]
        x, s, c = map(np.concatenate, zip(*parts))
        del parts
        order = np.lexsort((x, s))
        x, s = x[order], s[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (x[1:] != x[:-1])]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(c[order], first)
        sums[sums < least] = 0
        c[order] = sums[np.cumsum(new) - 1]
        kept = sums > 0
        shares = np.split(c, np.cumsum(sizes)[:-1])
        answers = [(r, k, _pack(y)) for r, k, y in zip(asked["range"], asked["chunk"], shares) if y.any()]
        r, k, packed = zip(*answers) if answers else ((), (), ())
        rows, none = int(kept.sum()), np.zeros(len(answers), np.int64)
        return pd.DataFrame(
            {
                "s": np.r_[_signed(s[first][kept]), none],
                "x": np.r_[_signed(x[first][kept]), none],
                "c": np.r_[sums[kept], none],
                "range": np.r_[np.full(rows, -1), np.array(r, np.int64)],
                "chunk": np.r_[np.full(rows, -1), np.array(k, np.int64)],
                "answer": [None] * rows + list(packed),
            }
        )

    asked = chunks.mapInPandas(count, PAIRS + ", chunk long").groupBy("range")
    both = stored(asked.applyInPandas(total, "s long, x long, c long, range int, chunk long, answer binary"), f"counts{depth}")
    answers = both.where(F.col("range") >= 0).select(F.lit(depth).alias("depth"), "range", "chunk", F.col("answer").alias("c"))
    return both.where(F.col("range") < 0).select("s", "x", "c"), answers


def tree(chunks: DataFrame, counts: DataFrame, n: int, v: int, bits: int) -> tuple[DataFrame, list]:
    """(key, c, rest): counts of states, and what they leave to shorter ones; steps of ``followers``.

    ``rest`` is in occurrences.  Whole numbers and quarters, unlike shares, pack well wherever they are
    written.  A step is (depth, bitmaps, frequent contexts, answers).
    """
    p0 = (F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))
    below = counts.select(F.lit(0).cast("long").alias("s"), F.col("key").alias("x"), p0.alias("p"))
    contexts = counts.where(F.col("c") >= MIN_CONTEXT).select(
        F.col("key").alias("s"), F.lit(0).cast("long").alias("shorter"), F.col("c").alias("total")
    )
    symbols, listed = bitmap(counts.where(F.col("c") >= MIN_NEXT)), frequent(counts)
    model, spreads, steps, lower = None, [], [], ()
    for depth in range(1, DEPTH + 1):
        gates = bitmap(contexts.select(F.col("s").alias("key"))), symbols, *lower
        # Fewer than eight to a range, for all counts together are n at most.
        often = [r["s"] for r in contexts.where(F.col("total") * (8 << bits) > n).select("s").collect()]
        often = np.array(often, np.int64).view(np.uint64)
        counted, answers = followers(chunks, depth, gates, often, bits, listed)
        steps.append((depth, gates, often, stored(answers, "answers")))
        shorter = below.select(F.col("s").alias("shorter"), "x", F.col("p").alias("q"))
        pairs = stored(counted.join(contexts, "s").join(shorter, ["shorter", "x"]), "followers")
        forget(counted)
        others = F.first("total") - F.sum("c")
        rest = others + F.lit(DISCOUNT) * F.count(F.lit(1))
        left = pairs.groupBy("s").agg(others.alias("others"), rest.alias("rest"), (rest / F.first("total")).alias("left"))
        p = (F.col("c") - DISCOUNT) / F.col("total") + F.col("left") * F.col("q")
        spread = stored(pairs.join(left, "s").withColumn("p", p), "spread")
        forget(pairs)
        gain = F.sum(F.col("c") * F.log(F.col("p") / F.col("q"))) + F.first("others") * F.log(F.first("left"))
        states = spread.groupBy("s").agg(gain.alias("gain"), F.first("total").alias("c"), F.first("rest").alias("rest"))
        states = stored(states.where(F.col("gain") >= MIN_GAIN).drop("gain"), "states")
        spreads += [spread, states]
        part = states.select(F.col("s").bitwiseXOR(F.lit(int(STATE))).alias("key"), "c", "rest")
        model = part if model is None else model.unionAll(part)
        contexts = spread.where(F.col("c") >= MIN_CONTEXT).select(
            joined_column("x", "s").alias("s"), joined_column("x", "shorter").alias("shorter"), F.col("c").alias("total")
        )
        below = spread.select("s", "x", "p")
        # A pair that is frequent enough is so with the shorter context.
        if depth < DEPTH:
            lower = (bitmap(spread.select(joined_column("x", "s").alias("key"))),)
    whole = stored(model, "tree")
    forget(*spreads)
    return whole, steps


def _states(chunk: Chunk, depth: int, worth: Bitmap) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of tokens whose context may be a state, and the context."""
    for at, context in chunk.contexts(depth):
        near = worth.of(context ^ STATE)
        yield at[near], context[near]


def _request(chunk: Chunk, worth: Bitmap) -> np.ndarray:
    """Keys of all that may be states, in ascending order."""
    keys = [_distinct(s ^ STATE) for depth in range(1, DEPTH + 1) for _, s in _states(chunk, depth, worth)]
    return _distinct(np.concatenate([np.empty(0, np.uint64), *keys]))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    chunks = stored(chunked(docs), "chunks")
    # Ranges go by the first bits of a key.
    bits = max(0, int(chunks.agg(F.sum("size")).first()[0] or 0) // RANGE).bit_length()
    counts, answers = followers(chunks, 0, (), NONE, bits)
    counts = counts.select(F.col("x").alias("key"), "c")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    model, steps = tree(chunks, counts, n, v, bits)
    answers = stored(answers, "answers")
    forget(counts)
    worth = bitmap(model)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe = Bitmap(worth.value)
        for pdf in batches:
            for row in pdf.itertuples():
                asked = _request(Chunk(row), maybe)
                ends = _ends(_first_bits(asked, bits), bits)
                found = [(r, row.chunk, _pack_keys(asked[i:j])) for r, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
                yield pd.DataFrame(found, columns=["range", "chunk", "keys"])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys = known["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        # A key that is unknown has 0.
        keys, c, rest = keys[order], known["c"].to_numpy(np.int64)[order], known["rest"].to_numpy(float)[order]
        keys, c, rest = np.r_[keys, np.uint64(0)], np.r_[c, 0], np.r_[rest, 0.0]
        found = []
        for row in asked.itertuples():
            wanted = _unpack_keys(row.keys)
            at = np.searchsorted(keys[:-1], wanted)
            at[keys[at] != wanted] = len(keys) - 1
            if c[at].any():
                found.append((row.range, row.chunk, _pack(c[at]), _pack(rest[at])))
        return pd.DataFrame(found, columns=["range", "chunk", "c", "rest"])

    requests = chunks.mapInPandas(ask, "range int, chunk long, keys binary")
    first = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)
    known = model.select(first.cast("int").alias("range"), "key", "c", "rest")
    found = requests.groupBy("range").cogroup(known.groupBy("range")).applyInPandas(
        answer, "range int, chunk long, c binary, rest binary"
    )
    # The states' answers go as depth -1.
    found = found.select(F.lit(-1).alias("depth"), "range", "chunk", "c", "rest")
    for own in (answers, *(own for *_, own in steps)):
        found = found.unionAll(own.withColumn("rest", F.lit(None).cast("binary")))
    asked = [(depth, gates, often) for depth, gates, often, _ in steps]

    def score(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        maybe = Bitmap(worth.value)
        parts = []
        for row in rows.itertuples():
            chunk = Chunk(row)

            def answered(depth: int, ends: np.ndarray, column: str = "c", kind: str = "<i8") -> np.ndarray:
                x = np.zeros(ends[-1], kind)
                for own in values[values["depth"] == depth].itertuples():
                    x[ends[own.range] : ends[own.range + 1]] = _unpack(getattr(own, column), kind)
                return x

            wanted = _request(chunk, maybe)
            ends = _ends(_first_bits(wanted, bits), bits)
            # An unknown key is at the end, with 0.
            states = Places(wanted)
            total, rest = np.r_[answered(-1, ends), 0].astype(float), np.r_[answered(-1, ends, "rest", "<f8"), 0.0]
            pairs = []
            for depth, gates, often in asked:
                x, s, _, ends = ranged(*_pairs(chunk, depth, tuple(Bitmap(g.value) for g in gates)), often, bits, True)
                c = answered(depth, ends)
                keys = joined(x[c > 0], s[c > 0])
                del x, s
                order = np.argsort(keys)
                pairs.append((Places(keys[order]), np.r_[c[c > 0][order], 0].astype(float)))
                del keys, order
            x, _, _, ends = ranged(*_pairs(chunk, 0, ()), NONE, bits)
            c = np.r_[answered(0, ends), 0].astype(float)
            starts = np.r_[0, chunk.ends[:-1] + 1] if len(chunk.ends) else chunk.ends
            add = lambda x: np.add.reduceat(x, starts)
            base = c[Places(x).of(chunk.vocabulary)][chunk.tokens]
            n_known = add((base > 0).astype(np.int64))
            base += 0.5
            base /= n + 0.5 * (v + 1)
            p = base.copy()
            base_score = add(np.log10(base, out=base))
            for depth, (places, c) in enumerate(pairs, 1):
                for at, context in _states(chunk, depth, maybe):
                    state = states.of(context ^ STATE)
                    real = total[state] > 0
                    at, state = at[real], state[real]
                    pair = places.of(joined(chunk._keys(at), context[real]))
                    p[at] = np.maximum(c[pair] - DISCOUNT, 0) / total[state] + rest[state] / total[state] * p[at]
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(i) else int(i) for i in chunk.doc_ids], "Int64"),
                        "n_tokens": chunk.counts,
                        "n_known": n_known,
                        "base_score": base_score,
                        "score": add(np.log10(p, out=p)),
                    }
                )
            )
        if not parts:
            return pd.DataFrame({x: [] for x in ("doc_id", "n_tokens", "n_known", "base_score", "score")})
        return pd.concat(parts)

    rated = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(
        score, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return rated.select(
        "doc_id",
        (fold() == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
