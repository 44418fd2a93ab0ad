"""Ranked search against scores of all documents, and the parts of the index by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import with_clashes
from markbook.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(ASCII))


def plain_ranked(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    out = set()
    for i, text in texts.items():
        found = []
        for d, bag in bags:
            m = 25 + 75 * sum(bag.values()) * count // total
            score = 0
            for t in plain_terms(text):
                if tf := bag.get(t):
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)}
    return out


def corpus(seed, n):
    draw = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"Rare{i}é" for i in range(300)]
    docs = []
    for d in range(n):
        words = draw.choices(common, k=draw.randrange(1, 60)) + draw.sample(rare, draw.randrange(4))
        docs.append((d, draw.choice([" ", "-", ", "]).join(words)))
    items = [(q, " ".join(draw.choices(common, k=6) + draw.sample(rare, 3))) for q in range(40)]
    return docs, items


def check(spark, docs, items):
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    q = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in ranking.ranked(d, q).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_ranked(docs, items)


@pytest.mark.parametrize("sizes", [None, (4, 32, 100, 7)])
def test_against_scores_of_all_documents(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "WINDOW", "DOCUMENTS", "QUERIES"), sizes or ()):
        monkeypatch.setattr(ranking, name, value)
    check(spark, *corpus(1, 900))


def test_edge_rows(spark):
    docs, items = corpus(2, 60)
    long = "needle " + "w1 W2 " * 60_000 + "needle"
    docs += [(None, "needle w1"), (None, None), (500, None), (501, ""), (502, " .\t"), (503, long), (504, "needle"), (505, "needle")]
    docs += [(506, "x\x00y ÉÉ Éé \U0001f600"), (3, "needle again"), (3, docs[3][1])]
    items += [(None, "needle"), (90, None), (91, ""), (92, "NEEDLE needle"), (93, "éé x É"), (94, "nowhere"), (92, "zz"), (95, "\U0001f600")]
    check(spark, docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3, 5)
    check(spark, [], items)
    check(spark, docs, [])


def test_numbers_round_trip():
    draw = np.random.default_rng(1)
    values = np.r_[0, 127, 128, 2**14 - 1, 2**14, 2**31, draw.integers(0, 2**20, 500)]
    data, at = ranking.packed(values)
    assert ranking.unpacked(data.tobytes()).tolist() == values.tolist()
    assert ranking.unpacked(data[at[3] : at[9]].tobytes()).tolist() == values[3:9].tolist()


def test_pieces_of_long_texts_cut_no_term(monkeypatch):
    text = " ".join(f"word{i}-Über" for i in range(300))
    whole = [w for part in ranking.terms(text) for w in part]
    monkeypatch.setattr(ranking, "PIECE", 50)
    assert [w for part in ranking.terms(text) for w in part] == whole == [t.encode() for t in plain_terms(text)]


def test_blocks_without_hope_stay_packed(spark):
    """A frequent term beside a rare one: only blocks with the rare term's documents are unpacked."""
    shard = ranking.Shard()
    for d in range(8000):
        shard.add(d, "often " * (1 + d % 3) + ("rare rare" if d % (97 if d < 2000 else 997) == 0 else "other"))
    head, *lists = (row for batch in shard.batches("0") for row in batch.to_pandas().to_dict("records"))
    sizes = head["sizes"].astype(np.int64)
    total = int(sizes.sum())
    measure = lambda c, s: 10**9 * c // (1000 * c + 8 * (25 + 75 * s * 8000 // total))
    known = {r["term"]: ranking.Postings(r, w, sizes, measure) for r in lists if (w := {b"often": 1, b"rare": 5000}.get(r["term"]))}
    found = ranking.search([(known[b"often"], 1), (known[b"rare"], 1)], head["ids"].astype(np.int64), [], 10)
    assert len(found) == 10
    # The first window has to be read whole, and a block for each rare document after it.
    assert len(known[b"often"].unpacked) <= ranking.WINDOW // ranking.BLOCK + 1 + 6
    assert len(known[b"often"].tops) > 60
