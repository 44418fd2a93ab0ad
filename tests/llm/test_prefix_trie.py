"""The prefix trie against plain dictionaries, and its tree by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from conftest import with_clashes
from markbook.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn, digest, (role, text)))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2]))
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(t[3] for t in own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return {
        (
            min(members[n]),
            len(n),
            min(members[n[:-1]]) if n else None,
            len(members[n]),
            len(below[n]),
            leaves[n],
            saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    }


def check(df, rows, **options):
    got = [tuple(r) for r in prefix_trie.nodes(df, **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_nodes(rows)


def crowded(seed, convs):
    """Few texts, so that sequences share long beginnings; a third of all conversations are one sequence."""
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        n = 4 if c % 3 == 0 else draw.randrange(1, 9)
        texts = [0] * n if c % 3 == 0 else [draw.randrange(2) for _ in range(n)]
        rows += [(c, t, ("user", "assistant")[t % 2], "word " * (x + 1) + "\U0001f600") for t, x in enumerate(texts)]
    return rows


EDGES = [
    (None, 0, "user", "no conversation"),
    (700, None, "user", "first"),
    (700, 0, "user", "second"),
    (700, 0, None, "second"),
    (700, 0, "user", "second"),
    (700, 1, "assistant", None),
    (700, 2, None, None),
    (-5, 0, "user", "below zero"),
    (-5, 3, "user", ""),
    (100_000_000_001, 0, "user", "alone"),
    (100_000_000_001, 1, "user", "x" * 200_000),
]


@pytest.mark.parametrize("options", [{}, {"shard": 5, "piece": 2}])
def test_nodes_against_plain_dictionaries(spark, options):
    rows = crowded(2, 330) + EDGES
    random.Random(1).shuffle(rows)
    check(with_clashes(spark.createDataFrame(rows, SCHEMA)), rows, **options)


def test_empty_table_has_no_nodes(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_with_many_turns(spark):
    rows = [(3, t, "user", f"{t}") for t in range(3000)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_sql_agrees_with_plain_dictionaries():
    rows = crowded(3, 120) + EDGES
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(prefix_trie.NODES_SQL)
    assert [d[0] for d in got.description] == [c.split()[0] for c in prefix_trie.NODES.split(", ")]
    assert set(got.fetchall()) == plain_nodes(rows)


def test_medians_balance_the_siblings():
    trie = prefix_trie.Trie()
    for i in prefix_trie.medians(1023):
        trie.insert([i], [1], i, 1, "")
    at = [trie.below[0]]
    deep = 0
    while at:
        at = [x for a in at for x in (trie.lower[a], trie.higher[a]) if x >= 0]
        deep += 1
    assert deep == 10
    assert sorted(trie.traversal()) == list(range(1024))
