"""Toxicity by compression distance.

Two zstandard dictionaries come from a bounded sample of labelled documents: one is trained on windows
of ordinary text, the other is joined from the segments that set toxic text apart from it; one trained
on windows of toxic text says little (README).  A window of text is
compressed with the ordinary dictionary and with both together; the bytes that the toxic one saves
are their distance.  Windows that save a byte are looked at again word by word, where neighbouring
words can't blur the difference.

Some segments tell when they occur once; others, chance parts of ordinary words too, tell only by how
often a document uses them.  The latter are longer, are counted as they stand (ordinary text holds
their parts, so they save little), and weigh by the likelihood of so many uses among so many words.
So do phrases of two or three words, and short words, which no segment inside one word can hold.  A document's largest saving, the number of
words that save enough and those likelihoods are turned into a score by a logistic curve, fitted on the
same sample so that 0.5 is the calibrated threshold; for that each half of the sample is measured with
dictionaries of the other.  How telling a segment has to be is the cut with the least loss there.

Only the training sample is bounded (``Sample``); every text is scored whole.  Defined results: a
null, empty or blank text saves nothing and gets the score of a text without findings; rows with
equal text get equal scores; without labels of both kinds every score is the prior (0 without any
labels); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_small_batches

WINDOW = 64
SEGMENT = 5
LEVEL_WINDOW = 3
LEVEL_WORD = 5
#: Bytes of the longest segment that tells by its uses, and the uses from which a document counts.
LONGEST_SEGMENT = 10
USES = 2
#: Phrases are looked for by buckets of their hashes first.
BUCKETS = 1 << 22
#: Log-odds that a segment may have to reach; the held-back halves decide.
CUTS = (4.0, 3.0, 2.0)


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: ids of each label, the longest document taken of them, and windows
    of ordinary text that a dictionary is trained on."""

    toxic: int = 1500
    ordinary: int = 3000
    longest: int = 8000
    pieces: int = 40_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    repeated: tuple[bytes, ...]
    phrases: tuple[bytes, ...]
    #: Uses a word in toxic and in ordinary documents, of repeated segments and of phrases.
    rates: tuple[tuple[float, float], tuple[float, float]]
    #: Logistic curve over (1, largest saving, words that save 3 bytes or more, likelihoods of the uses).
    weights: tuple[float, ...]


def _words(text: str | None) -> list[bytes]:
    return [b" " + w for w in (text or "").lower().encode().split()]


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Runs of whole words of about ``size`` bytes; a longer word is cut with an overlap."""
    run: list[bytes] = []
    length = 0
    for word in words:
        for at in range(0, max(1, len(word) - 16), size) if len(word) > 2 * size else (0,):
            piece = word[at : at + size + 16] if len(word) > 2 * size else word
            if run and length + len(piece) > size:
                yield b"".join(run)
                run, length = [], 0
            run.append(piece)
            length += len(piece)
    if run:
        yield b"".join(run)


class Meter:
    """Bytes that the toxic dictionary saves."""

    def __init__(self, ordinary: bytes, toxic: bytes, repeated: tuple[bytes, ...] = (), phrases: tuple[bytes, ...] = ()) -> None:
        import zstandard

        def compressor(content: bytes, level: int):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # Shorter matches than a segment would say nothing.
            how = zstandard.ZstdCompressionParameters.from_level(
                level,
                dict_size=len(content),
                min_match=SEGMENT,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            known.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress

        # Dictionaries index every third position or so, and never the last ones: copies, each shifted by
        # one, see to it that each segment is found.
        padded = toxic + b" " * (-len(toxic) % 6 + 1)
        both = ordinary + 6 * padded + b"\n" * 16
        self.at_window = compressor(ordinary, LEVEL_WINDOW), compressor(both, LEVEL_WINDOW)
        self.at_word = compressor(ordinary, LEVEL_WORD), compressor(both, LEVEL_WORD)
        self.repeated, self.phrases = repeated, phrases
        # A match can't begin in the last bytes of a block, and a block that doesn't shrink is kept raw:
        # known text follows each window.
        self.tail = (ordinary[-400:-352] or b" ").ljust(48, b" ")

    def savings(self, text: str | None) -> tuple[int, int, int, int, int]:
        """The largest saving of a word, the number of words that save 3 bytes or more, uses of
        repeated segments and of phrases, and the number of words."""
        (a, b), (c, d), tail = self.at_window, self.at_word, self.tail
        most = many = 0
        words = _words(text)
        whole = b"".join(words) + b" "
        uses, said = (sum(map(whole.count, known)) for known in (self.repeated, self.phrases))
        for window in windows(words):
            framed = window + tail
            if len(a(framed)) <= len(b(framed)):
                continue
            for word in window.split():
                framed = b" " + word + tail
                saved = len(c(framed)) - len(d(framed))
                most = max(most, saved)
                many += saved >= 3
        return most, many, uses, said, len(words)


class Counts:
    """Words and segments of labelled documents, from which segments are picked by any cut."""

    def __init__(self, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> None:
        self.toxic, self.ordinary = toxic, ordinary
        self.least = max(6, len(toxic) // 100)
        self.here, self.inside, self.inside_places = _counted(toxic)
        there, self.outside, self.outside_places = _counted(ordinary)
        self.all_here, self.all_there = self.here.total(), there.total()
        # Documents that use a longer segment often enough; only those of toxic ones are looked for.
        self.users: dict[bytes, set[int]] = defaultdict(set)
        for i, words in enumerate(toxic):
            for g, n in _uses(words).items():
                if n >= USES:
                    self.users[g].add(i)
        self.users = {g: ids for g, ids in self.users.items() if len(ids) >= self.least}
        self.others: Counter = Counter()
        kept: dict[bytes, list[bytes]] = {}
        for words in ordinary:
            self.others.update(g for g, n in _uses(words, self.users, kept).items() if n >= USES)
        self.sayers, self.others_say = self._phrases()

    def _phrases(self) -> tuple[dict[bytes, set[int]], Counter]:
        """Toxic documents of each phrase that has enough of them, and enough words before it: what
        copies share has one.  Ordinary documents of these phrases."""
        buckets = np.zeros(BUCKETS, np.uint32)
        for words in self.toxic:
            buckets[np.unique([hash(g) % BUCKETS for g, _ in _runs(words)] or [0])] += 1
        ids: dict[bytes, set[int]] = defaultdict(set)
        before: dict[bytes, set[int]] = defaultdict(set)
        for i, words in enumerate(self.toxic):
            for g, last in _runs(words):
                if buckets[hash(g) % BUCKETS] >= self.least:
                    ids[g].add(i)
                    before[g].add(hash(last))
        ids = {g: own for g, own in ids.items() if min(len(own), len(before[g])) >= self.least}
        others: Counter = Counter()
        for words in self.ordinary:
            others.update({g for g, _ in _runs(words) if g in ids})
        return ids, others


def _grams(word: bytes, size: int = SEGMENT) -> set[bytes]:
    return {word[i : i + size] for i in range(len(word) - size + 1)}


def _counted(docs: list[list[bytes]]) -> tuple[Counter, Counter, Counter]:
    """Places of each word, documents of each segment, places of each segment."""
    seen: set[int] = set()
    places: Counter = Counter()
    by_document: Counter = Counter()
    for words in docs:
        by_document.update(set().union(*map(_grams, set(words))))
        for pair in set(zip([b"", *words], words)):
            if hash(pair) not in seen:
                seen.add(hash(pair))
                places[pair[1]] += 1
    by_place: Counter = Counter()
    for word, n in places.items():
        by_place.update(dict.fromkeys(_grams(word), n))
    return places, by_document, by_place


def _uses(words: list[bytes], only: dict[bytes, set[int]] | None = None, known: dict[bytes, list[bytes]] | None = None) -> Counter:
    """Words of a document that hold each segment longer than ``SEGMENT``; ``known`` keeps those of a word."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        if known is None or word not in known:
            grams = [g for size in range(SEGMENT + 1, LONGEST_SEGMENT + 1) for g in _grams(word, size) if only is None or g in only]
            if known is not None:
                known[word] = grams
        else:
            grams = known[word]
        for g in grams:
            found[g] += n
    return found


def _runs(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Words too short for a segment, and runs of two and three words, each with the word before it."""
    last = b""
    for i, word in enumerate(words):
        if len(word) < SEGMENT:
            yield word + b" ", last
        for n in (2, 3):
            if i + n <= len(words):
                yield b"".join(words[i : i + n]) + b" ", last
        last = word


def _odds(a: int, b: int, all_a: int, all_b: int) -> float:
    return math.log((a + 0.5) / (all_a + 1)) - math.log((b + 0.5) / (all_b + 1))


def telling_uses(counts: Counts, cut: float, known: list[bytes]) -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """Segments that toxic documents use again and again, and few ordinary ones do; phrases likewise.

    Those that share their bytes with ``known`` segments, phrases also with repeated ones, have told
    already.
    """
    repeated = _covering(counts, counts.users, counts.others, cut, known)
    return repeated, _covering(counts, counts.sayers, counts.others_say, cut, [*known, *repeated])


def _covering(counts: Counts, users: dict[bytes, set[int]], others: Counter, cut: float, known: list[bytes]) -> tuple[bytes, ...]:
    """Picked greedily by the documents that none of the earlier ones reaches, longer ones first among
    equals."""
    sizes = len(counts.toxic), len(counts.ordinary)
    told = set().union(*map(_grams, known))
    telling = {g: ids for g, ids in users.items() if _odds(len(ids), others[g], *sizes) > cut and not _grams(g) & told}
    covered: set[int] = set()
    heap = [(-len(ids), -len(g), g) for g, ids in telling.items()]
    heapq.heapify(heap)
    chosen = []
    while heap:
        was, size, g = heapq.heappop(heap)
        new = len(telling[g] - covered)
        if new < counts.least:
            continue
        if new < -was:
            heapq.heappush(heap, (-new, size, g))
            continue
        covered |= telling[g]
        chosen.append(g)
    return tuple(chosen)


def toxic_segments(counts: Counts, cut: float) -> list[bytes]:
    """Byte segments of words that are much more frequent in toxic text.

    Both ways of counting have to say so: by documents, and by words together with the word before
    them.  A word that one document repeats fails the first, one that copies share fails the second.
    Segments are picked greedily: the next one has the most places (word and word before) that none of
    the earlier ones covers; it grows to both sides while most of its words agree.
    """
    here, inside_places, least = counts.here, counts.inside_places, counts.least
    sizes = len(counts.toxic), len(counts.ordinary)
    telling = {
        g
        for g, n in counts.inside.items()
        if min(n, inside_places[g]) >= least
        and _odds(n, counts.outside[g], *sizes) > cut
        and _odds(inside_places[g], counts.outside_places[g], counts.all_here, counts.all_there) > cut - 1
    }
    items: dict[bytes, set[bytes]] = defaultdict(set)
    for word in here:
        for g in _grams(word) & telling:
            items[g].add(word)
    covered: set[bytes] = set()
    heap = [(-inside_places[g], g) for g in items]
    heapq.heapify(heap)
    chosen = []
    while heap:
        was, g = heapq.heappop(heap)
        new = items[g] - covered
        worth = sum(here[w] for w in new)
        if worth < least:
            continue
        if worth < -was:
            heapq.heappush(heap, (-worth, g))
            continue
        covered |= new
        grown = _grown(g, Counter({w: here[w] for w in sorted(new)}))
        # Only stretches whose every part tells, or ordinary words would match the rest.
        start = 0
        for end in range(SEGMENT, len(grown) + 2):
            if end > len(grown) or grown[end - SEGMENT : end] not in telling:
                if end - 1 - start > SEGMENT:
                    chosen.append(grown[start : end - 1])
                start = end - SEGMENT + 1
        if len(g) == len(grown):
            chosen.append(g)
    return list(dict.fromkeys(chosen))


def _grown(segment: bytes, words: Counter) -> bytes:
    total = sum(words.values())
    while True:
        longer: Counter = Counter()
        for word, n in words.items():
            at = word.find(segment)
            if at > 0:
                longer[word[at - 1 : at] + segment] += n
            if 0 <= at < len(word) - len(segment):
                longer[word[at : at + len(segment) + 1]] += n
        best = longer.most_common(1)
        if not best or best[0][1] < 0.6 * total:
            return segment
        segment = best[0][0]


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the pieces themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def train(texts: list[str | None], labels: list[int], pieces: int = Sample.pieces) -> Model:
    """Fit both dictionaries and the curve; texts that repeat count once."""
    rows = sorted({(t or "", int(y)) for t, y in zip(texts, labels)})
    marked = sum(1 for _, y in rows if y)
    prior = (marked + 0.5) / (len(rows) + 1) if rows else 0.0
    if not 0 < marked < len(rows):
        base = math.log(prior / (1 - prior)) if rows else -math.inf
        return Model(b"", b"", (), (), ((1.0, 1.0), (1.0, 1.0)), (base, 0.0, 0.0, 0.0, 0.0))
    # Documents share the objects of equal words.
    pool: dict[bytes, bytes] = {}
    known = [([pool.setdefault(w, w) for w in _words(t)], y) for t, y in rows]
    del pool
    # The curve is fitted on savings that no document has a part in itself: each half is measured
    # with the dictionaries of the other one.
    y = np.array([y for _, y in rows], float)
    halves = []
    for half in (0, 1):
        base, counts = _learned([r for i, r in enumerate(known) if i % 2 != half], pieces)
        halves.append([(base, *_lexicons(counts, cut)) for cut in CUTS])
        # The counts are by far the largest thing here; one half's are gone before the next ones are made.
        del counts
    best = None
    for cut, parts in zip(CUTS, zip(*halves)):
        meters = [Meter(*part) for part in parts]
        found = np.array([meters[i % 2].savings(t) for i, (t, _) in enumerate(rows)], float)
        rates = _rates(found, y)
        x = np.column_stack([np.ones(len(rows)), *features(found, rates)])
        weights = _logistic(x, y)
        loss = float(np.logaddexp(0, (1 - 2 * y) * (x @ weights)).sum())
        if best is None or loss < best[0]:
            best = loss, cut, rates, weights
    _, cut, rates, weights = best
    base, counts = _learned(known, pieces)
    return Model(base, *_lexicons(counts, cut), rates, weights)


def _learned(known: list[tuple[list[bytes], int]], pieces: int) -> tuple[bytes, Counts]:
    """The ordinary dictionary, and the counts that the toxic ones are picked from."""
    ordinary = [words for words, y in known if not y]
    return _dictionary(_drawn(ordinary, pieces), 16_384), Counts([words for words, y in known if y], ordinary)


def _drawn(docs: list[list[bytes]], n: int) -> list[bytes]:
    """At most ``n`` windows of all documents, drawn by their number so that only these are held."""
    order = list(range(sum(1 for words in docs for _ in windows(words))))
    random.Random(1).shuffle(order)
    place = {number: i for i, number in enumerate(order[:n])}
    del order
    every = enumerate(w for words in docs for w in windows(words))
    return [w for _, w in sorted((place[number], w) for number, w in every if number in place)]


def _lexicons(counts: Counts, cut: float) -> tuple[bytes, tuple[bytes, ...], tuple[bytes, ...]]:
    """Segments that tell when they occur once, those that tell by their uses, and phrases."""
    once = toxic_segments(counts, cut)
    return b"".join(reversed(once)), *telling_uses(counts, cut, once)


def _rates(found: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Uses a word in toxic documents with enough of them, and in ordinary documents."""
    rates = []
    for uses, least in ((found[:, 2], USES), (found[:, 3], 1)):
        often = (y > 0) & (uses >= least)
        rare = float((uses[y == 0].sum() + 0.5) / (found[y == 0, 4].sum() + 1))
        rates.append((max(float(uses[often].sum() / found[often, 4].sum()) if often.any() else 0.0, 2 * rare), rare))
    return tuple(rates)


def features(found: np.ndarray, rates: tuple[tuple[float, float], ...]) -> list[np.ndarray]:
    """What the curve is over: the largest saving, words that save 3 bytes or more (at most 5), and how
    much likelier the uses are in a toxic document (log, 0 to 10), so that long texts don't add up."""
    likelier = [
        np.clip(found[:, at] * math.log(often / rare) - found[:, 4] * (often - rare), 0, 10)
        for at, (often, rare) in zip((2, 3), rates)
    ]
    return [found[:, 0], np.minimum(found[:, 1], 5), *likelier]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps for the penalised likelihood; slopes stay at 0 or above."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """Train on documents of folds 1 to 4: per label the first ids by a hash, at most as many as
    ``sample`` allows.

    Only these ids are broadcast, and only their texts go to the driver.  One label per document
    counts, the highest if they differ.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [
        known.where((F.col("__toxic") > 0) == F.lit(label)).orderBy(*order).limit(n)
        for label, n in ((True, sample.toxic), (False, sample.ordinary))
    ]
    ids = F.broadcast(parts[0].unionAll(parts[1]))
    rows = docs.where(F.octet_length("text") <= sample.longest).select("doc_id", "text").join(ids, "doc_id")
    rows = rows.orderBy(*order, "text").limit(sample.toxic + sample.ordinary).select("text", "__toxic").collect()
    return train([r[0] for r in rows], [int(r[1] > 0) for r in rows], sample.pieces)


def score(model: Model, column: str = "text") -> F.Column:
    """Score from 0 to 1 of a text column."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        meter = Meter(model.ordinary, model.toxic, model.repeated, model.phrases) if model.ordinary else None
        for texts in batches:
            found = np.array([meter.savings(t) if meter else (0, 0, 0, 0, 0) for t in texts], float).reshape(-1, 5)
            z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features(found, model.rates)))
            yield pd.Series([1 / (1 + math.exp(min(-x, 700.0))) if x > -700 else 0.0 for x in z], dtype=float)

    return rate(F.col(column))


def scored(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rated = in_small_batches(docs).select("doc_id", (fold() == 0).alias("held_out"), score(fit(docs, labels, sample)).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    rated = in_small_batches(docs).withColumn("__score", score(fit(docs, labels, sample)))
    return rated.where("__score < 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))
