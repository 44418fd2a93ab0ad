"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``SIZE`` signs, drawn from its code point.  A trigram binds the
vectors of its letters, each permuted (rotated) by its place, by multiplication; a text bundles its
trigrams by addition; a language bundles the trigrams of its training documents, each document's
counts scaled to length 1.  The mean of the
prototypes is taken off both sides, since what all languages share tells nothing, and the prototype
with the largest cosine names the language.

Prototypes are sums over all training documents, made of integers, so that their order doesn't matter.
One vector per language reaches the driver.  Defined results: a text that is null or has no letter is
``und`` with score 0; without training rows every text is; equal cosines go to the language that
sorts first; a null ``lang`` or doc_id trains nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

SIZE = 512
GRAM = 3
UNIT = 1 << 20
UNKNOWN = "und"
#: Trigrams whose vectors a worker keeps; only a memory bound.
KEPT = 40_000


#: Which code points are letters, and the vectors of those met so far; plain containers, which are sent by value.
_LETTERS: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vector(code: int) -> np.ndarray:
    if code not in _VECTORS:
        _VECTORS[code] = np.where(np.random.default_rng(code).random(SIZE) < 0.5, -1, 1).astype(np.int8)
    return _VECTORS[code]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of lower-case letters, with one space for whatever stands between them."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return codes, codes
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32)
    kept = letter | np.r_[False, letter[:-1]]
    codes = np.r_[32, codes[kept], 32]
    if not letter.any():
        return codes[:0], codes[:0]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


class Space:
    """Vectors of the trigrams seen so far."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, SIZE), np.float32)

    def _row(self, gram: int) -> int:
        at = len(self.rows)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        vector = np.ones(SIZE, np.int8)
        for place in range(GRAM):
            vector = vector * np.roll(letter_vector(gram >> (21 * place) & 0x1FFFFF), place)
        self.matrix[at] = vector
        self.rows[gram] = at
        return at

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if len(self.rows) > KEPT:
            self.rows.clear()
        known = self.rows
        total = np.zeros(SIZE)
        for i in range(0, len(grams), 4096):
            at = [known[g] if g in known else self._row(g) for g in grams[i : i + 4096].tolist()]
            total += weights[i : i + 4096].astype(np.float32) @ self.matrix[at]
        return total


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from the documents of folds 1 to 4."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Space(), {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = [trigrams(t) for t in texts]
                scaled = [(g, n / np.linalg.norm(n)) for g, n in found if len(g)]
                if not scaled:
                    continue
                grams, at = np.unique(np.concatenate([g for g, _ in scaled]), return_inverse=True)
                weights = np.bincount(at, np.concatenate([n for _, n in scaled]))
                own = sums.setdefault(lang, np.zeros(SIZE, np.int64))
                own += np.rint(space.bundle(grams, weights) * UNIT).astype(np.int64)
        yield pd.DataFrame({"lang": list(sums), "part": list(sums.values())})

    parts = docs.where((fold() != 0) & F.col("lang").isNotNull()).select("lang", "text")
    parts = parts.mapInPandas(bundle, "lang string, part array<long>")
    sums = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    rows = sorted((r["lang"], r["v"]) for r in whole.collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), SIZE)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the score is (1 + cosine) / 2."""
    names, sums = prototypes(docs)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(SIZE)
    apart = unit - mean
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Space()
        for texts in batches:
            out = []
            for text in texts:
                grams, counts = trigrams(text)
                if not names or not len(grams):
                    out.append((UNKNOWN, 0.0))
                    continue
                vector = space.bundle(grams, counts)
                own = vector / max(float(np.linalg.norm(vector)), 1e-300) - mean
                cosines = apart @ own / max(float(np.linalg.norm(own)), 1e-300)
                best = int(np.argmax(cosines))
                out.append((names[best], float(min(1.0, max(0.0, (1 + cosines[best]) / 2)))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    rated = docs.select("doc_id", (fold() == 0).alias("held_out"), predict("text").alias("p"))
    return rated.select("doc_id", "held_out", "p.*")
