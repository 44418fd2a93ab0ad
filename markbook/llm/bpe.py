"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) is turned into vocabulary and merges once on the driver; the model
text (1.5 MB, fixed by the vocabulary) is broadcast.  Every byte is one printable character of a
fixed alphabet, so tokens are character strings; decoding reverses that alphabet.

Defined results: null text encodes to no ids (empty binary), like the empty text; null ids decode to
empty bytes.  Texts of any length are encoded whole.  Ids outside the vocabulary raise an error.
Rows are independent, so repeated rows give equal results and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches

#: Bytes of units and their ids that a worker keeps between batches, and what one unit takes besides its
#: own; only a memory bound, results don't depend on it.
KEPT_BYTES, UNIT_BYTES = 48 << 20, 200


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``: merge by rank, below the token's own rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_text(ranks: dict[bytes, int], pattern: str) -> str:
    """The model of the tokenizers library, as its JSON text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    pairs = [_merge_of(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    model = models.BPE(
        vocab={shown[t]: rank for t, rank in ranks.items()},
        merges=[(shown[a], shown[b]) for a, b in pairs],
        ignore_merges=True,
    )
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


#: A space at which a text can be cut, since no match of the pattern can reach across: it stands
#: between two characters that aren't white space, so the match on its left ends there and the next one
#: begins with it.  Other white space stays inside a unit.
_CUT = re.compile(r" (?<=\S )(?=\S)")


class Encoder:
    """Encodes texts unit by unit; a unit goes to the tokenizer once while it is kept.

    New units of a batch are encoded together: joined by spaces, they are cut again at the same
    places, and the token lengths tell which ids belong to which unit.
    """

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found.ids, "<u4")

    def _add(self, units: list[str]) -> None:
        """Encode ``" " + unit`` of every unit, some at a time."""
        for at in range(0, len(units), 20_000):
            some = units[at : at + 20_000]
            ids = self._ids(" " + " ".join(some))
            ends = np.cumsum([len(u.encode()) + 1 for u in some])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1
            packed = ids.tobytes()
            start = 0
            for unit, end in zip(some, (4 * cuts).tolist()):
                self.kept[unit] = packed[start:end]
                self.size += UNIT_BYTES + len(unit) + end - start
                start = end

    def packed(self, texts: list[str], together: int = 500) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), together):
            if self.size > KEPT_BYTES:
                self.kept.clear()
                self.size = 0
            cut = [_CUT.split(t) for t in texts[at : at + together]]
            self._add(list({u for units in cut for u in units[1:] if u not in self.kept}))
            kept = self.kept
            for units in cut:
                first = self._ids(units[0]).tobytes()
                out.append(b"".join([first, *map(kept.__getitem__, units[1:])]))
        return out


class Codec:
    """Vocabulary on the driver, with column functions that use it on the executors."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = read_ranks(file.readlines())
        self._model = spark.sparkContext.broadcast(tokenizer_text(ranks, pattern))

    def packed_ids(self, column: str) -> F.Column:
        """Ids as little-endian unsigned 32-bit integers, without a gap."""
        model = self._model

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = Encoder(model.value)
            for texts in batches:
                yield pd.Series(encoder.packed(["" if t is None else t for t in texts]), dtype=object)

        return encode(F.col(column))

    def round_trip(self, column: str) -> F.Column:
        """``ids`` (packed), the SHA-256 of the bytes that they decode to, and if these are the text's.

        One worker does both ways, so the vocabulary is held once and texts go to Python once.
        """
        model = self._model

        @F.pandas_udf("ids binary, decoded_sha256 string, exact boolean")
        def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder, to_bytes = Encoder(model.value), token_bytes(model.value)
            for texts in batches:
                rows = []
                whole = ["" if t is None else t for t in texts]
                for text, packed in zip(whole, encoder.packed(whole)):
                    data = b"".join(map(to_bytes, np.frombuffer(packed, "<u4").tolist()))
                    rows.append((packed, hashlib.sha256(data).hexdigest(), data == text.encode()))
                yield pd.DataFrame(rows, columns=["ids", "decoded_sha256", "exact"])

        return code(F.col(column))

    def with_offsets(self, df: DataFrame, column: str) -> DataFrame:
        """Adds ``ids``, ``starts`` and ``ends``: token ids and their character ranges in the text.

        The tokens of a character that is split among them all get that character's range.
        """
        model = self._model

        @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tokenizer = Encoder(model.value).tokenizer
            for texts in batches:
                found = [tokenizer.encode(t or "", add_special_tokens=False) for t in texts]
                yield pd.DataFrame(
                    {
                        "ids": [x.ids for x in found],
                        "starts": [[a for a, _ in x.offsets] for x in found],
                        "ends": [[b for _, b in x.offsets] for x in found],
                    }
                )

        return df.withColumn("__t", encode(F.col(column))).select(
            *(F.col(f"`{c}`") for c in df.columns if c not in ("ids", "starts", "ends")), "__t.*"
        )

    def decoded(self, column: str) -> F.Column:
        """The bytes of packed ids: the token's characters through the reversed byte alphabet."""
        model = self._model

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            to_bytes = token_bytes(model.value)
            for packed in batches:
                yield pd.Series(
                    [b"".join([to_bytes(i) for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in packed],
                    dtype=object,
                )

        return decode(F.col(column))


def token_bytes(model: str) -> Callable[[int], bytes]:
    import json

    byte = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = json.loads(model)["model"]["vocab"]
    table = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items()}
    return table.__getitem__


def texts(column: str) -> F.Column:
    """Decoded bytes as text.

    A character may be split among tokens; it is whole again once the bytes stand together.  Bytes
    that are no UTF-8 (ids cut inside a character) become U+FFFD.
    """

    @F.pandas_udf("string")
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda x: (x or b"").decode("utf-8", "replace"))

    return read(F.col(column))


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return in_small_batches(docs).select("doc_id", codec.round_trip("text").alias("coded")).select(
        "doc_id",
        F.expr("octet_length(coded.ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.col("coded.decoded_sha256").alias("decoded_sha256"),
    )
