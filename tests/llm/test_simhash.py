"""SimHash fingerprints, Golay keys and groups against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from markbook.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """{(doc_id, fingerprint): component} by comparing all pairs."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    known = [(d, p) for d, p in rows if d is not None]
    for d, p in known:
        root(d)
        for e, q in known:
            if (p ^ q).bit_count() <= 2:
                x, y = root(d), root(e)
                up[max(x, y)] = min(x, y)
    return {(d, f"{p:016x}"): root(d) if d is not None else None for d, p in rows}


def check(df, **options):
    rows = [(r.doc_id, plain_print(r.text)) for r in df.select("doc_id", "text").collect()]
    got = simhash.grouped(df, **options).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint): r.component_id for r in got} == plain_groups(rows)


def test_documents_against_all_pairs(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edge_rows(documents, no_documents):
    check(documents)
    assert simhash.grouped(no_documents).collect() == []


def test_fingerprint_of_long_text_counts_across_pieces(monkeypatch):
    draw = random.Random(1)
    text = " ".join(draw.choice("abcdefghij") for _ in range(5000))
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    assert simhash.fingerprint(text) == plain_print(text)


def test_hash_is_that_of_spark(spark):
    text = "Één  zwei\tThree"
    want = spark.range(1).select(F.xxhash64(F.lit("Één zwei three")).alias("h")).first().h
    assert simhash.fingerprint(text) == want % 2**64


def test_golay_code_decodes_every_word_to_the_one_codeword_nearby():
    tables = simhash.golay_tables()
    draw = np.random.default_rng(3)
    words = draw.integers(0, 1 << 23, 200)
    codewords = np.array([m << 11 for m in range(4096)])
    check = tables[0][0][codewords & 255] ^ tables[0][1][codewords >> 8 & 255] ^ tables[0][2][codewords >> 16]
    codewords ^= check
    assert np.bitwise_count(codewords[1:]).min() == 7
    apart = np.bitwise_count(words[:, None] ^ codewords)
    assert (apart.min(axis=1) <= 3).all() and ((apart <= 3).sum(axis=1) == 1).all()
    assert (simhash.segment_keys(words, 23, tables)[:, 0] == apart.argmin(axis=1)).all()


def test_all_pairs_within_two_bits_share_a_key():
    draw = random.Random(5)
    tables = simhash.golay_tables()
    base = draw.getrandbits(64)
    near = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)] + [base ^ (1 << i) for i in range(64)]
    every = simhash.keys(np.array(near, np.uint64).view(np.int64), tables)
    first = set(every[0].tolist())
    assert all(first & set(k.tolist()) for k in every)
    assert max(map(len, every)) <= 18


@pytest.mark.parametrize("bucket", [2, 128])
def test_links_of_a_large_group_are_whole_and_few(spark, bucket):
    """Prints within a few bits of one another: the same groups, however large a bucket may be."""
    draw = random.Random(7)
    base = draw.getrandbits(64)
    prints = {base ^ sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3, 5]))) for _ in range(700)}
    prints |= {draw.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.linked(spark.createDataFrame([(p,) for p in signed], "print long"), bucket).collect()
    up = {p: p for p in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert ((a ^ b) % 2**64).bit_count() <= 64
        up[root(a)] = root(b)
    got = defaultdict(set)
    for p in signed:
        got[root(p)].add(p)
    want = plain_groups([(p, p % 2**64) for p in signed])
    groups = defaultdict(set)
    for (p, _), c in want.items():
        groups[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
