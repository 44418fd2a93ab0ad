"""BPE, mixing, near duplicates, personal data and the suffix tree against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from markbook.llm import bpe, minhash, mixing, pii, suffix_tree

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


# --- byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").readlines())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken_and_round_trips(documents, codec, reference):
    texts = {(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()}
    got = {tuple(r) for r in bpe.digests(documents, codec).collect()}
    want = set()
    for i, t in texts:
        ids = np.asarray(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_bpe_units_on_odd_texts(codec, reference):
    draw = random.Random(4)
    space = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x85", "\xa0", " ", "　", "\x1c"]
    odd = ["'s", "é", "́", "\U0001f600", "²", "a", "B", "7", ".", "<|endoftext|>", "中"]
    texts = ["".join(draw.choice(draw.choice([space, odd])) for _ in range(draw.randrange(30))) for _ in range(3000)]
    packed = bpe.Encoder(codec._model.value).packed(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_offsets_and_split_characters(spark, codec):
    df = spark.createDataFrame([("a \U0001f600 b",), (None,)], "text string")
    row = codec.with_offsets(df, "text").collect()
    assert len(row[0].ids) == len(row[0].starts) and row[0].ends[-1] == 5
    assert row[1].ids == []
    cut = df.select(codec.packed_ids("text").alias("p")).select(F.substring("p", 1, 8).alias("p"))
    decoded = cut.select(codec.decoded("p").alias("b")).select(bpe.texts("b").alias("t")).collect()
    assert decoded[0].t.startswith("a") and decoded[1].t == ""


def test_bpe_empty_table(no_documents, codec):
    assert bpe.digests(no_documents, codec).count() == 0


# --- mixing -----------------------------------------------------------------------------------


def shares(sizes):
    """Targets by resharing again and again what exceeds three times a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        unit, before = left / sum(weight[s] for s in open_), left
        for s in list(open_):
            room = 3 * sizes[s] - target[s]
            give = min(room, unit * weight[s])
            target[s] += give
            left -= give
            if give >= room:
                open_.discard(s)
        if left == before:
            break
    return target


def test_mixing_targets_and_copies(documents):
    rows = mixing.taken(documents).collect()
    assert len(rows) == documents.count()
    sizes = Counter()
    for r in documents.select("text", "source").collect():
        sizes[r.source] += len(words(r.text))
    want = shares(sizes)
    taken, longest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.01 * longest[s]
    assert sorted(rows, key=str) == sorted(mixing.taken(documents).collect(), key=str)


def test_mixing_emits_what_it_takes(documents):
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = Counter()
    for r in mixed.select("source", "text").collect():
        got[r.source] += len(words(r.text))
    want = Counter()
    for r in mixing.taken(documents).collect():
        want[r.source] += r.taken
    assert +got == +want


def test_mixing_empty_table(no_documents):
    assert mixing.taken(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0


# --- near duplicates --------------------------------------------------------------------------


def groups(rows):
    """(n, smallest reachable id) by comparing all pairs."""
    sets = {i: frozenset(zip(*(words(t)[k:] for k in range(5)))) or frozenset([tuple(words(t))]) for i, t in rows if words(t)}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets.get(i, ())), root(i)) for i, _ in rows}


def test_near_duplicates_equal_brute_force(documents):
    got = minhash.grouped(documents).collect()
    assert len(got) == documents.count()
    want = groups([(r.doc_id, r.text) for r in documents.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1])


def test_near_duplicates_in_one_large_spread_group(spark):
    """Copies of one text with random edits: many pairs lie on either side of the threshold."""
    draw = random.Random(2)
    text = [f"w{draw.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(400):
        own = list(text)
        for _ in range(draw.randrange(9)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_pairs_from_80_percent_up_are_linked_where_asked_for(spark):
    """Pairs that share 76 to 90 % of their shingles, in sets of 60, 180 and 600."""
    import corpus_pipeline

    draw = random.Random(5)
    rows, want = [], set()
    for i in range(240):
        size = (60, 180, 600)[i % 3]
        text = [f"v{i}_{k}" for k in range(size + 4)]
        cut = round(size * draw.uniform(0.1, 0.24))
        other = text[cut:]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        if 100 * (size - cut) >= 80 * size:
            want.add(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert {i for i, _ in rows} - kept == want
    assert {r.doc_id for r in minhash.grouped(docs, 80).where("NOT kept").collect()} == want
    assert len({r.doc_id for r in minhash.grouped(docs).where("NOT kept").collect()}) < len(want)


def test_second_round_links_at_the_threshold_asked_for(spark):
    """Members of one bucket in two groups, at 81 %, of sizes that 85 % would not compare."""
    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    marks = [minhash._signed(s)[1] for s in (base, base[:81])]
    rows = [(7, 0, 1, 100, 1, bytearray(marks[0])), (7, 0, 2, 81, 2, bytearray(marks[1]))]
    members = spark.createDataFrame(rows, "key long, band int, doc_id long, n int, group long, marks binary")
    sets = spark.createDataFrame([(i + 1, bytearray(np.sort(x).tobytes())) for i, x in enumerate((base, base[:81]))], "doc_id long, shingles binary")
    found = {t: [tuple(r) for r in minhash._across(members, sets, t).collect()] for t in (80, 85)}
    assert found == {80: [(1, 2)], 85: []}


def linked(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in pairs:
        up[root(x)] = root(y)
    return root


@pytest.mark.parametrize("others", [1, 40, 300])
def test_a_hot_bucket_is_dealt_in_small_groups(spark, monkeypatch, others):
    """One bucket with a main group and some others: rows of each group of a task, and links that connect all."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TOGETHER", 64)
    own = np.sort(np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mark = bytearray(minhash._signed(own)[1])
    rows = [(7, 0, i, 100, i if i < others else 10_000, mark) for i in range(others + 600)]
    members = spark.createDataFrame(rows, "key long, band int, doc_id long, n long, group long, marks binary")
    dealt, size = minhash._cells(members)
    shard = F.pmod(F.xxhash64("key", "i", "j"), F.lit(size // 64 + 1))
    sizes = [r["count"] for r in dealt.groupBy(shard).count().collect()]
    assert sum(sizes) == size and max(sizes) <= 6 * 64
    if others == 1:
        assert size <= 600 + 600 // 16 + 3
    if others < 300:
        sets = members.select("doc_id", F.lit(bytearray(own.tobytes())).alias("shingles"))
        root = linked((r.a, r.b) for r in minhash._across(members, sets).collect())
        assert len({root(i) for i in range(others)} | {root(i) for i in range(others, others + 600) if root(i) != i}) == 1


def test_a_bucket_of_near_copies_gives_fewer_links_than_members(spark):
    """2,000 copies with up to 8 edits, each a group of its own: no more links than a forest has, the same groups."""
    draw = random.Random(4)
    text = [f"w{draw.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(2000):
        own = list(text)
        for _ in range(draw.randrange(9)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        rows.append((i, minhash.shingles(" ".join(own))))
    listed = [(7, 0, i, len(x), i, bytearray(minhash._signed(x)[1])) for i, x in rows]
    members = spark.createDataFrame(listed, "key long, band int, doc_id long, n long, group long, marks binary").repartition(4)
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in rows], "doc_id long, shingles binary")
    found = [(r.a, r.b) for r in minhash._across(members, sets).collect()]
    # Two blocks make three cells.
    assert len(found) < 3 * 2000
    root = linked(found)
    whole = [set(x.tolist()) for _, x in rows]
    groups = [root(i) for i in range(2000)]
    for i in range(0, 2000, 40):
        for j in range(2000):
            both = len(whole[i] & whole[j])
            if 100 * both >= 85 * (len(whole[i]) + len(whole[j]) - both):
                assert groups[i] == groups[j]
    for a, b in found:
        both = len(whole[a] & whole[b])
        assert 100 * both >= 85 * (len(whole[a]) + len(whole[b]) - both)


def test_second_round_compares_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    test_near_duplicates_in_one_large_spread_group(spark)


@pytest.mark.parametrize("per_task", [500_000, 3])
def test_components_of_a_chain(spark, monkeypatch, per_task):
    monkeypatch.setattr(minhash, "PER_TASK", per_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(101, 100)], "a long, b long").repartition(7)
    found = {r.doc_id: r.component_id for r in minhash.components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.r_[a[:270], draw.integers(0, 2**63, 30, dtype=np.uint64)]
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - 270 / 330) < 0.12
    assert (minhash.signature(a[:1]) == minhash.signature(a[:1])).all()


def test_deduplicated(documents, no_documents):
    kept = minhash.deduplicated(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(ids)[None] == 2 and max(Counter(i for i in ids if i is not None).values()) == 1
    assert minhash.deduplicated(no_documents).count() == 0 and minhash.grouped(no_documents).count() == 0


# --- personal data ----------------------------------------------------------------------------

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


#: What each match holds; on a long run without it, Python's search takes quadratic time to find nothing.
HOLDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text):
    found = [
        (m.start(), i, kind, m.end())
        for i, (kind, rule) in enumerate(RULES.items())
        if HOLDS[kind] in (text or "")
        for m in re.finditer(rule, text or "")
        if valid(kind, m.group())
    ]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def check_spans(docs):
    for r in docs.select("doc_id", "text").distinct().join(pii.found(docs).distinct(), "doc_id").collect():
        want = base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.text
        kinds = Counter(x.split(":")[0] for x in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in RULES]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


def test_base_spans_on_random_texts(spark):
    draw = random.Random(9)
    bits = ["a", "B", "@", ".", "..", "-", "+", "_", "%", " ", "(", ")", "1", "25", "255", "256", "0001", "é", "\U0001f600"]
    bits += ["x@y.zz", "4539578763621486", "+1 (509) 555-6973", "10.0.0.1", " 4539 5787 6362 1486", "@a.b_c@d.e"]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(25)))) for i in range(1500)]
    check_spans(spark.createDataFrame(rows, "doc_id long, text string"))


def test_spans_on_edge_rows_and_tables(documents, no_documents, spark):
    check_spans(documents.where("doc_id IS NOT NULL"))
    assert pii.found(documents).count() == documents.count()
    assert pii.found(no_documents).count() == 0
    check_spans(spark.read.parquet(f"{SF}/documents.parquet"))


def test_spans_of_very_long_runs(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1.1" * 100_000, "1 " * 150_000, "a.b@" * 60_000, "+1" + "(" * 200_000, "@" * 100_000]
    rows = list(enumerate(texts))
    check_spans(spark.createDataFrame(rows, "doc_id long, text string"))


def test_method_adds_spoiled_numbers_and_secrets(spark):
    rows = [(i, f"Call +1 (509) 555-6{i:03d} today or mail a{i}@b.org") for i in range(60)]
    rows += [(100, "Des +1 (826) 555-4081 190.137.223.204 du")]
    rows += [(200 + i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(30)]
    rows += [(300 + i, "plain words only, nothing else to see") for i in range(50)]
    spans = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "phone:4:21" in spans[100] and "ip:22:37" in spans[100]
    assert spans[200].startswith("secret:9:")
    assert not any(spans[300 + i] for i in range(50))


def test_redaction(documents, no_documents):
    got = pii.redacted(documents)
    assert got.columns == documents.columns and got.count() == documents.count()
    row = got.where("doc_id = 1").first()
    assert row.text == "Mail <EMAIL> or call <PHONE> now" and row.n_chars == len(row.text)
    assert got.where("doc_id = 2").first().text is None
    assert pii.redacted(no_documents).count() == 0


def test_redaction_equals_brute_force(spark):
    """Overlapping spans, characters beyond the basic plane, and more spans than a block holds."""
    draw = random.Random(4)
    bits = ["\U0001f600 ", "é", "a@b.cc ", " +1 (509) 555-6973 ", "4539578763621486", "@1.2.3.4.de ", "10.0.0.1 ", " und "]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.choice([3, 12, 700])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for i, text in rows:
        out, at = [], 0
        for x in spans[i].split(",") if spans[i] else []:
            kind, start, end = x.split(":")
            if int(start) >= at:
                out += [text[at : int(start)], f"<{kind.upper()}>"]
            at = max(at, int(end))
        assert got[i] == "".join(out) + text[at:]


# --- suffix tree ------------------------------------------------------------------------------


def base_scores(rows):
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)

    def of(text):
        own = [*words(text), None]
        return len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)

    return of


def test_base_scores_and_edge_rows(documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    of = base_scores(rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(of(t)[:3])
    got = suffix_tree.scored(documents).collect()
    assert len(got) == len(rows)
    by_id = {i: of(t) for i, t in rows if i is not None}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) in texts[r.doc_id]
        if r.doc_id is None:
            assert r.held_out is None
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, by_id[r.doc_id][3], rel_tol=1e-9)
    assert suffix_tree.scored(no_documents).count() == 0


def test_chunks_do_not_change_scores(documents, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MIN_CONTEXT", 8)
    whole = sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect())
    monkeypatch.setattr(suffix_tree, "CHUNK", 500)
    monkeypatch.setattr(suffix_tree, "BITS", 1 << 15)
    small = sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect())
    assert small == whole


def test_ranges_of_keys_do_not_change_scores(documents, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MIN_CONTEXT", 8)
    whole = sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect())
    monkeypatch.setattr(suffix_tree, "RANGE", 5_000)
    ranged = sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect())
    assert ranged == whole


def test_keys_are_packed_and_found():
    draw = np.random.default_rng(5)
    keys = suffix_tree._distinct(draw.integers(0, 1 << 64, 300_000, np.uint64, endpoint=False))
    packed = suffix_tree._pack_keys(keys)
    # A row of a key and its chunk is 16 bytes and more.
    assert len(packed) < 6.5 * len(keys)
    assert (suffix_tree._unpack_keys(packed) == keys).all()
    known, close = keys[::3], np.arange(5, dtype=np.uint64)
    for own in (known, close, known[:1], known[:0]):
        asked = np.r_[keys, close, np.uint64(2**64 - 1)]
        at = {int(k): i for i, k in enumerate(own)}
        assert suffix_tree.Places(own).of(asked).tolist() == [at.get(int(k), len(own)) for k in asked]


def test_pairs_travel_packed_and_frequent_symbols_are_spread():
    draw = np.random.default_rng(6)
    hashes = draw.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    x, s = hashes[draw.zipf(1.3, 400_000) % 20_000], hashes[draw.zipf(1.3, 400_000) % 2_000]
    want = Counter(zip(x.tolist(), s.tolist()))
    often = hashes[1:2]
    x, s, c, ends = suffix_tree.ranged(x, s, np.ones(len(x), np.int32), often, 4)
    rows = suffix_tree.packed_pairs(x, s, c, ends)
    # A row of a context, a symbol and a count took more than 17 bytes.
    assert rows.drop(columns="range").map(len).to_numpy().sum() < 8 * len(x)
    got = Counter()
    for row in rows.itertuples():
        for a, b, n in zip(*(y.tolist() for y in suffix_tree.unpacked_pairs(row))):
            assert (b if a == int(often[0]) else a) >> 60 == row.range
            got[a, b] += n
    assert got == want


def test_pairs_of_frequent_words_stay_small_in_many_ranges():
    draw = np.random.default_rng(8)
    hashes = draw.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    x, s = hashes[draw.zipf(1.2, 400_000) % 20_000], hashes[draw.zipf(1.2, 400_000) % 2_000]
    want = Counter(zip(x.tolist(), s.tolist()))
    often, listed = hashes[1:2], np.sort(hashes[:19_000])
    each = []
    for bits in (2, 8):
        *pairs, ends = suffix_tree.ranged(x, s, np.ones(len(x), np.int32), often, bits, by_context=True)
        rows = suffix_tree.packed_pairs(*pairs, ends, listed)
        each.append(rows.drop(columns="range").map(len).to_numpy().sum() / len(pairs[0]))
        got = Counter()
        for row in rows.itertuples():
            for a, b, n in zip(*(y.tolist() for y in suffix_tree.unpacked_pairs(row, listed))):
                assert (a if b == int(often[0]) else b) >> 64 - bits == row.range
                got[a, b] += n
        assert got == want
    # By ranges of symbols, with the key of each word: 2.7 and 7.0 bytes.
    assert each[0] < 2.5 and each[1] < 3


def test_listed_words_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "LISTED", 100)
    counts = spark.createDataFrame([(i - 500, i) for i in range(1, 1_001)], "key long, c long")
    keys = suffix_tree._unpack_keys(suffix_tree.frequent(counts).value)
    found = sorted(keys.view(np.int64).tolist())
    assert found == list(range(501 - len(found), 501)) and 50 < len(found) <= 100
    assert (np.diff(keys) > 0).all()
    assert not len(suffix_tree._unpack_keys(suffix_tree.frequent(counts.where("c > 2000")).value))


def test_listed_words_do_not_change_scores(documents, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MIN_CONTEXT", 8)
    whole = sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect())
    monkeypatch.setattr(suffix_tree, "RANGE", 5_000)
    for most in (50, 0):
        monkeypatch.setattr(suffix_tree, "LISTED", most)
        assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 8)) for r in suffix_tree.scored(documents).collect()) == whole


def test_numbers_are_packed_by_size():
    x = (np.random.default_rng(7).zipf(1.2, 200_000) % 300_000).astype(np.int32)
    packed = suffix_tree._pack_numbers(x)
    assert (suffix_tree._unpack_numbers(*packed) == x).all()
    assert sum(map(len, packed)) < len(suffix_tree._pack(x))


def test_tree_equals_brute_force(spark, monkeypatch):
    """States, discounts and back-off of a small corpus, computed token by token."""
    for name, value in {"MIN_CONTEXT": 5, "MIN_NEXT": 2, "MIN_PAIR": 2, "MIN_GAIN": 2.0}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["a b c", "a b d", "e b f", "g", "h i"]) for _ in range(8))) for i in range(60)]
    train = [[*words(t), None] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    unigram = Counter(w for t in train for w in t)
    n, v = sum(unigram.values()), len(unigram)
    p0 = lambda x: (unigram[x] + 0.5) / (n + 0.5 * (v + 1))
    total = {0: {(): n}, 1: {(w,): c for w, c in unigram.items() if w is not None}}
    shares, left, states, known = {}, {}, set(), {}
    for depth in (1, 2):
        pairs = Counter()
        for t in train:
            for k in range(depth, len(t)):
                s, x = tuple(t[k - depth : k]), t[k]
                if total[depth].get(s, 0) >= 5 and unigram[x] >= 2:
                    pairs[s, x] += 1
        pairs = {k: c for k, c in pairs.items() if c >= 2 and (depth == 1 or (k[0][1:], k[1]) in known)}
        by = defaultdict(dict)
        for (s, x), c in pairs.items():
            by[s][x] = c
        new = {}
        for s, own in by.items():
            rest = 1 - sum(c - 0.75 for c in own.values()) / total[depth][s]
            gain = (total[depth][s] - sum(own.values())) * math.log(rest)
            for x, c in own.items():
                q = p0(x) if depth == 1 else known[s[1:], x]
                new[s, x] = (c - 0.75) / total[depth][s] + rest * q
                gain += c * math.log(new[s, x] / q)
            if gain >= 2.0:
                states.add(s)
                left[s] = rest
                shares.update({(s, x): (c - 0.75) / total[depth][s] for x, c in own.items()})
        known = new
        total[depth + 1] = {(*s, x): c for (s, x), c in pairs.items() if x is not None}
    assert any(len(s) == 2 for s in states)

    def score(text):
        t, out = [*words(text), None], 0.0
        for k, x in enumerate(t):
            p = p0(x)
            for depth in (1, 2):
                s = tuple(t[k - depth : k]) if k >= depth else None
                if s in states:
                    p = shares.get((s, x), 0.0) + left[s] * p
            out += math.log10(p)
        return out

    texts = dict(rows)
    for r in suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert math.isclose(r.score, score(texts[r.doc_id]), rel_tol=1e-9)
        if not r.held_out:
            assert r.score >= r.base_score - 3
