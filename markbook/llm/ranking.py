"""Ranked lexical search: Block-Max MaxScore over a sharded inverted index.

Index.  A task cuts its documents into shards.  A shard holds, for each of its terms, the postings (document,
occurrences) in blocks of ``BLOCK``: documents as gaps, both numbers in seven bits a byte.  Beside a block stand its last document and the pairs (occurrences, document size) that no other
posting of the block beats in both: whatever the corpus, one of these pairs has the block's best score.  A shard
also has its documents' ids and sizes.  The index doesn't depend on any query; it is written once.

Statistics.  The number of documents, of all terms, and of a queried term's documents are sums over shards.

Search.  Queried terms' postings are dealt out with blocks of queries.  A shard is worked off in windows of
documents.  Lists are ordered by their best score.  As long as the bounds of the first of these together
stay below the k-th best score so far, a document that is only in them can't count: they are non-essential.
Candidates come from the other, essential lists.  The non-essential ones are then taken from the best
bound down: candidates that can't reach the k-th score with all that is left are dropped, first by the list's
bound, then by the maximum of the block in which they would stand, and only blocks that still have a
candidate are unpacked.  Heaps go on from shard to shard of a task; the heaps of tasks are merged.

Skew.  A shard has up to ``DOCUMENTS`` documents or ``TERMS`` terms, so a frequent term has many short lists; no
task holds a term's whole list.  Nothing is broadcast, and ties with the k-th score stay until ids decide.

Defined results: a null text has no terms, as has an empty one, and isn't counted; texts are read whole.
Rows that repeat a doc_id are documents of their own.  A document without an id counts in the statistics but
isn't returned (nor one whose id is the least of all longs).  Of items that repeat an id the smallest text counts; items without an id take no part; an
item without terms has no rows.  Equal scores go by doc_id.  Empty tables give an empty table.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, stored

K = 10
BLOCK = 128
#: Documents or terms, with repeats, that a shard has at most (one document may have more terms).
DOCUMENTS, TERMS = 16_384, 2_000_000
#: Bytes of text that are cut into terms in one go.
PIECE = 1 << 20
#: Documents of a window, queries of a block, postings that a search task is worth.
WINDOW, QUERIES, POSTINGS = 2_048, 1_024, 1_000_000
#: Share of the score that length decides, in percent.
LENGTH_SHARE = 75

#: Stands for a missing id; the least of all longs.
NO_ID = -(1 << 63)

#: Bytes of terms stay (A-Z as a-z), all others become spaces.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a whole text, ``PIECE`` bytes at a time."""
    rest = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(rest):
        end = rest.find(b" ", at + PIECE)
        end = len(rest) if end < 0 else end
        yield rest[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, the last byte of each below 128; and where each begins, with the end."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >> bits > 0
    at = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(at[-1], np.uint8)
    for i in range(5):
        has = sizes > i
        more = sizes[has] > i + 1
        out[at[:-1][has] + i] = (values[has] >> 7 * i & 127) | more << 7
    return out, at


def unpacked(data: bytes) -> np.ndarray:
    """The numbers that ``packed`` made bytes of."""
    own = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(own < 128)
    starts = np.r_[0, ends[:-1] + 1]
    within = np.arange(len(own)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((own & 127) << 7 * within, starts)


class Shard:
    """Documents that are gathered until they are enough for a shard."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids, self.sizes, self.terms, self.counts = [], [], [], []
        self.total = 0

    def add(self, doc_id, text: str | None) -> None:
        found: list[np.ndarray] = []
        for words in terms(text):
            found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        n = sum(map(len, found))
        if n:
            own, counts = np.unique(np.concatenate(found), return_counts=True)
            self.ids.append(doc_id)
            self.sizes.append(n)
            self.terms.append(own)
            self.counts.append(counts)
            self.total += n

    def full(self) -> bool:
        return len(self.ids) >= DOCUMENTS or self.total >= TERMS

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        """The shard's documents and lists as rows of the index."""
        sizes = np.array(self.sizes, np.int64)
        docs = np.repeat(np.arange(len(sizes)), [len(t) for t in self.terms])
        term, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(term, kind="stable")
        term, docs, counts = term[order], docs[order], counts[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        lengths = np.diff(np.r_[starts, len(term)])
        place = np.arange(len(term)) - np.repeat(starts, lengths)
        new = place % BLOCK == 0
        block = np.cumsum(new) - 1
        # Within a block by falling occurrences and rising sizes: a pair counts where the size is a new least.
        best = np.lexsort((sizes[docs], -counts, block))
        fall = sizes[docs][best] - block[best] * (int(sizes.max()) + 1)
        kept = best[np.r_[True, fall[1:] < np.minimum.accumulate(fall)[:-1]]]
        gaps = np.where(new, 0, docs - np.r_[0, docs[:-1]])
        data, at = packed(np.stack([gaps, counts], axis=1).ravel())
        first = np.flatnonzero(new)
        of_list = np.r_[block[starts], len(first)]
        of_block = np.searchsorted(block[kept], np.arange(len(first) + 1))
        lasts = docs[np.r_[first[1:], len(docs)] - 1]
        begins = at[2 * first] - at[2 * np.repeat(starts, np.diff(of_list))]
        names = list(self.numbers)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        borders = pa.array(np.r_[at[2 * starts], len(data)], pa.int32()).buffers()[1]
        n = len(starts)
        rows = [
            pa.array([name] * n),
            pa.array([names[i] for i in term[starts]], pa.binary()),
            pa.array(lengths),
            lists(of_list, lasts),
            lists(of_list, begins),
            pa.Array.from_buffers(pa.binary(), n, [None, borders, pa.py_buffer(data)]),
            lists(of_list, np.diff(of_block)),
            lists(of_block[of_list], counts[kept]),
            lists(of_block[of_list], sizes[docs[kept]]),
        ]
        listed = pa.RecordBatch.from_arrays(
            rows + [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64())], COLUMNS
        )
        none = [pa.nulls(1, a.type) for a in rows]
        none[0], none[2] = pa.array([name]), pa.array([len(sizes)])
        head = [pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.sizes], pa.list_(pa.int32())), pa.array([self.total])]
        yield pa.RecordBatch.from_arrays(none + head, COLUMNS)
        for i in range(0, n, 10_000):
            yield listed.slice(i, 10_000)


LISTS = (
    "shard string, term binary, n long, lasts array<int>, starts array<int>, postings binary, pairs array<int>, "
    "pair_counts array<int>, pair_sizes array<int>, ids array<long>, sizes array<int>, total long"
)


COLUMNS = [c.split()[0] for c in LISTS.split(", ")]


def index(docs: DataFrame) -> DataFrame:
    """The inverted index of doc_id and text: rows of lists, and one row a shard with its documents (null term)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                shard.add(doc_id, text)
                if shard.full():
                    yield from shard.batches(f"{task}-{number}")
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.batches(f"{task}-{number}")

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return in_small_batches(docs).select(own, "text").mapInArrow(build, LISTS)


def questions(items: DataFrame) -> DataFrame:
    """item_id, block, and its terms (distinct, sorted) with their repeats."""

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[w for part in terms(t) for w in part] for t in texts], dtype=object)

    one = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = F.pmod(F.xxhash64("item_id"), F.lit(1 + (one.count() - 1) // QUERIES))
    every = one.select("item_id", blocks.cast("int").alias("block"), F.explode(cut("text")).alias("term"))
    return every.groupBy("item_id", "block", "term").agg(F.count(F.lit(1)).alias("repeats"))


class Postings:
    """A term's list in one shard, with its scores for one corpus; blocks are unpacked when asked for."""

    def __init__(self, row, weight: int, sizes: np.ndarray, measure):
        self.lasts, self.starts, self.data = row["lasts"], row["starts"], row["postings"]
        self.weight, self.sizes, self.measure = weight, sizes, measure
        pairs = measure(row["pair_counts"].astype(np.int64), row["pair_sizes"].astype(np.int64)) * weight
        self.tops = np.maximum.reduceat(pairs, np.r_[0, np.cumsum(row["pairs"])[:-1]])
        self.top = int(self.tops.max())
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their scores."""
        if i not in self.unpacked:
            end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.data)
            gaps, counts = unpacked(self.data[self.starts[i] : end]).reshape(-1, 2).T
            docs = np.cumsum(gaps) + (int(self.lasts[i]) - int(gaps.sum()))
            self.unpacked[i] = docs, self.measure(counts, self.sizes[docs]) * self.weight
        return self.unpacked[i]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from low to below high, and their scores."""
        a, b = np.searchsorted(self.lasts, [low, high])
        found = [self.block(i) for i in range(a, min(b + 1, len(self.lasts)))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, scores = (np.concatenate(x) for x in zip(*found))
        inside = slice(*np.searchsorted(docs, [low, high]))
        return docs[inside], scores[inside]

    def add(self, docs: np.ndarray, scores: np.ndarray, rest: int, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that this list and ``rest`` can still lift to ``least``, with their scores here added."""
        at = np.searchsorted(self.lasts, docs)
        bound = np.where(at < len(self.lasts), self.tops[np.minimum(at, len(self.tops) - 1)], 0) * repeats
        kept = scores + bound + rest >= least
        docs, scores, at = docs[kept], scores[kept], at[kept]
        for i in np.unique(at[at < len(self.lasts)]):
            own, gained = self.block(int(i))
            here = slice(*np.searchsorted(at, [i, i + 1]))
            where = np.searchsorted(own, docs[here]).clip(max=len(own) - 1)
            scores[here] += np.where(own[where] == docs[here], gained[where], 0) * repeats
        return docs, scores


def search(lists: list[tuple[Postings, int]], ids: np.ndarray, found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (minus score, id) of a shard's documents and of ``found``; lists come with their repeats."""
    lists = sorted(lists, key=lambda x: x[0].top * x[1])
    bounds = np.cumsum([p.top * r for p, r in lists])
    for low in range(0, len(ids), WINDOW):
        least = -found[-1][0] if len(found) == k else 1
        idle = int(np.searchsorted(bounds, least))
        if idle == len(lists):
            break
        parts = [(p.between(low, low + WINDOW), r) for p, r in lists[idle:]]
        docs = np.unique(np.concatenate([d for (d, _), _ in parts]))
        scores = np.zeros(len(docs), np.int64)
        for (own, gained), repeats in parts:
            scores[np.searchsorted(docs, own)] += gained * repeats
        for i in range(idle - 1, -1, -1):
            hopeful = scores + bounds[i] >= least
            docs, scores = docs[hopeful], scores[hopeful]
            if not len(docs):
                break
            docs, scores = lists[i][0].add(docs, scores, int(bounds[i - 1]) if i else 0, least, lists[i][1])
        good = (scores >= least) & (ids[docs] != NO_ID)
        if good.any():
            new = sorted(zip((-scores[good]).tolist(), ids[docs[good]].tolist()))[:k]
            found = sorted(found + new)[:k]
    return found


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    lists = stored(index(docs), "ranking-index")
    asked = stored(questions(items), "ranking-questions")
    heads = lists.where("term IS NULL")
    counts = heads.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, total = counts["n"] or 0, counts["total"] or 1
    wanted = asked.select("block", "term").distinct()
    hits = stored(lists.where("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi"), "ranking-hits")
    weight = F.floor(F.log(F.lit(2.0 * documents + 2) / (2 * F.sum("n") + 1)) * 1000)
    weights = hits.groupBy("term").agg(weight.alias("weight"), F.sum("n").alias("df"))
    postings = hits.agg(F.sum("n")).first()[0] or 0
    parts = (postings + documents) // POSTINGS + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part")

    weighted = asked.join(weights.select("term", "weight"), "term").groupBy("item_id", "block").agg(
        F.collect_list(F.struct("term", "weight", "repeats")).alias("terms")
    )
    left = weighted.select(
        "item_id", "terms", F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q_part")
    )
    last = asked.agg(F.max("block")).first()[0] or 0
    of_lists = wanted.join(hits, "term").select("block", part, *COLUMNS)
    of_heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).select("block", part, *COLUMNS)

    def measure(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        base = 100 - LENGTH_SHARE + LENGTH_SHARE * sizes * documents // total
        return 1_000_000_000 * counts // (1000 * counts + 8 * base)

    def find(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in queries["item_id"]}
        weight = {t["term"]: t["weight"] for own in queries["terms"] for t in own}
        for _, shard in rows.groupby("shard") if best else ():
            head = shard[shard["term"].isna()].iloc[0]
            sizes = head["sizes"].astype(np.int64)
            ids = head["ids"].astype(np.int64)
            own = shard[shard["term"].notna()].to_dict("records")
            known = {r["term"]: Postings(r, weight[r["term"]], sizes, measure) for r in own if r["term"] in weight}
            for item, needed in zip(queries["item_id"], queries["terms"]):
                here = [(known[t["term"]], t["repeats"]) for t in needed if t["term"] in known]
                if here:
                    best[item] = search(here, ids, best[item], k)
        out = [(i, d, -s) for i, found in best.items() for s, d in found]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score"], dtype="int64")

    dealt = of_lists.unionByName(of_heads).groupBy("block", "part")
    found = left.groupBy("q_block", "q_part").cogroup(dealt).applyInPandas(find, "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


RANKED_SQL = f"""
WITH numbered AS (SELECT doc_id, text, row_number() OVER () AS place FROM documents),
cut AS (
  SELECT doc_id, place, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM numbered),
postings AS (SELECT doc_id, place, term, count(*) AS tf FROM cut GROUP BY ALL),
sized AS (SELECT place, sum(tf)::BIGINT AS n FROM postings GROUP BY place),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, stats GROUP BY term),
items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM items),
scored AS (
  SELECT a.item_id, p.place, p.doc_id,
    sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * s.n * t.docs) // t.total))))::BIGINT AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN sized s ON s.place = p.place, stats t
  WHERE p.doc_id IS NOT NULL GROUP BY a.item_id, p.place, p.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
