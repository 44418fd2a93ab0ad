"""Prefix trie of conversations, by ternary search trees over dictionary-encoded turns.

Turns.  A turn is a role and a text; turns are ordered within their conversation.  Every distinct turn gets
a number (a written dictionary, keyed by SHA-256), and texts stay behind: a conversation becomes an array
of numbers, and the lengths of the texts travel beside them.

Shards.  Conversations with one sequence are merged: their ids become sorted pieces of text, each of at
most ``PIECE`` ids.  Sequences are dealt to range shards in their own order, so what lies below a node is a
run of neighbours, whatever share of all conversations it is, and a hot first turn is cut like any other.
A shard reads its rows in order; the hash of the ids that end at a sequence grows piece by piece.

Trees.  Each shard inserts its sequences into a ternary search tree, the median first, so that the siblings
of every level are a balanced binary tree.  An iterative traversal lists the nodes, and members, children,
leaves and savings are added up from the deepest ones.

Boundaries.  Only prefixes of a shard's first and last sequence can go on in another shard.  Every other node
is complete.  Of those prefixes a shard gives what it holds below them, as one row for each of the two
sequences; these few rows (two a shard) are merged in order of their sequences with one stack, and the
nodes that stand just below learn their parent from the outcome.

Defined results: rows without a conv_id take no part; turns of one number are ordered by their SHA-256;
repeated rows are turns of their own; texts count whole, in code points.  Conversations that have no
rebuilt turns are members of the root.  A table without conversations has no nodes, not even a root.  One
conversation is one array, eight bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: The first turns of every such conversation stand in for those of the ones that follow it.
FAMILY = 100
#: Numbers of replaced turns: one less at most.
REPLACED = 6
#: Ids whose text is put together in one row.
PIECE = 4096
#: Turns that a shard is worth.
SHARD = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
#: A node, with the border place of its parent; or what a shard holds at and below the prefixes of one of
#: its border sequences, by depth.
SHARD_ROW = (
    "conv_id long, depth long, parent_conv_id long, shard long, side long, place long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "turns array<long>, depths array<long>, firsts array<long>, members array<long>, children array<long>, "
    "leaves array<long>, savings array<long>, lengths array<long>, ends array<string>"
)


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), number of the turn, length of its text, for every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        digest.alias("digest"),
        F.length(text).cast("long").alias("length"),
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    turns = stored(slim.withColumn("place", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    words = turns.groupBy("digest").agg(F.lit(1).alias("one"))
    numbers = stored(words.select("digest", F.monotonically_increasing_id().alias("number")), "trie-dictionary")
    return turns.join(numbers, "digest").select("conv_id", "place", "number", "length")


def rebuilt(turns: DataFrame, family: int = FAMILY, replaced: int = REPLACED) -> DataFrame:
    """conv_id, turns (numbers) and lengths: the family's first turns, then the conversation's own after as many."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(replaced))
    own = turns.withColumn("h", h)
    every = own.select("conv_id", "h").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    heads = turns.where(F.col("place") < replaced - 1).select(
        F.col("conv_id").alias("base"), F.col("place").alias("at"), "number", "length"
    )
    borrowed = every.join(heads, "base").where("at < h")
    rest = own.where("place >= h").select("conv_id", "h", F.col("place").alias("at"), "number", "length")
    # Borrowed places are below h, the others are not.
    rows = borrowed.select("conv_id", "h", "at", "number", "length").unionByName(rest)
    turn = F.struct("at", "number", "length")
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("list"))
    none = F.array().cast("array<long>")
    return every.join(found.withColumnRenamed("conv_id", "found"), F.col("conv_id") == F.col("found"), "left").select(
        "conv_id",
        F.coalesce(F.col("list.number"), none).alias("turns"),
        F.coalesce(F.col("list.length"), none).alias("lengths"),
    )


def sequences(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Distinct sequences with their members' ids in pieces: turns, lengths, part, first, members, ids."""
    part = F.floor(F.col("conv_id") / piece).alias("part")
    return conversations.groupBy("turns", part).agg(
        F.first("lengths").alias("lengths"),
        F.min("conv_id").alias("first"),
        F.count(F.lit(1)).alias("members"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
    )


class Trie:
    """Ternary search tree over numbers; node 0 is the root, which has no number."""

    def __init__(self):
        self.number, self.parent, self.depth, self.length = [-1], [-1], [0], [0]
        self.lower, self.higher, self.below = [-1], [-1], [-1]
        self.first, self.members, self.ends = [None], [0], [NO_ENDS]

    def insert(self, turns, lengths, first: int, members: int, ends: str) -> None:
        at = 0
        for turn, length in zip(turns, lengths):
            at = self._child(at, turn, length)
        self.first[at], self.members[at], self.ends[at] = first, members, ends

    def _child(self, parent: int, turn: int, length: int) -> int:
        side, before, at = self.below, parent, self.below[parent]
        while at >= 0:
            if turn == self.number[at]:
                return at
            side, before = (self.lower if turn < self.number[at] else self.higher), at
            at = side[at]
        at = side[before] = len(self.number)
        self.number.append(turn)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.length.append(length)
        for link in (self.lower, self.higher, self.below):
            link.append(-1)
        self.first.append(None)
        self.members.append(0)
        self.ends.append(NO_ENDS)
        return at

    def traversal(self) -> list[int]:
        """All nodes, each before those below it."""
        out, ahead = [], [0]
        while ahead:
            at = ahead.pop()
            out.append(at)
            ahead += [x for x in (self.lower[at], self.higher[at], self.below[at]) if x >= 0]
        return out

    def path(self, turns) -> list[int]:
        """Nodes of a sequence that the tree holds, the root first."""
        out = [0]
        for turn in turns:
            at = self.below[out[-1]]
            while self.number[at] != turn:
                at = self.lower[at] if turn < self.number[at] else self.higher[at]
            out.append(at)
        return out


def medians(n: int) -> list[int]:
    """0 to n - 1, the middle one first, then the middles of both halves, and so on."""
    out, spans = [], [(0, n)]
    for low, high in spans:
        if low < high:
            middle = (low + high) // 2
            out.append(middle)
            spans += [(low, middle), (middle + 1, high)]
    return out


def shard_rows(found: list[tuple], shard: int) -> tuple[list[tuple], list[tuple]]:
    """Nodes of a shard's sorted sequences (turns, lengths, first, members, ends), and its borders.

    A node row ends with shard, border and place if its parent is a border node, with nulls otherwise.
    """
    trie = Trie()
    for i in medians(len(found)):
        trie.insert(*found[i])
    n = len(trie.number)
    first, members = list(trie.first), list(trie.members)
    children, leaves, savings = [0] * n, [0] * n, [0] * n
    paths = [trie.path(found[0][0]), trie.path(found[-1][0])]
    shared = sum(a == b for a, b in zip(*paths))
    place = {node: (0, at) for at, node in enumerate(paths[0])} | {node: (1, at) for at, node in enumerate(paths[1][shared:])}
    rows = []
    order = trie.traversal()
    for at in reversed(order):
        up = trie.parent[at]
        if at not in place:
            leaves[at] = leaves[at] or 1
            savings[at] += (members[at] - 1) * trie.length[at]
            children[up] += 1
            leaves[up] += leaves[at]
            savings[up] += savings[at]
        if up >= 0:
            members[up] += members[at]
            first[up] = first[at] if first[up] is None else min(first[up], first[at])
    for at in order:
        if at not in place:
            up = trie.parent[at]
            known = (first[up], None, None, None) if up not in place else (None, shard, *place[up])
            rows.append((first[at], trie.depth[at], *known, members[at], children[at], leaves[at], savings[at], trie.ends[at]))
    borders = []
    for side, nodes in enumerate((paths[0], paths[1][shared:])):
        values = [[column[x] for x in nodes] for column in (trie.depth, first, members, children, leaves, savings, trie.length, trie.ends)]
        if nodes:
            borders.append((shard, side, [trie.number[x] for x in paths[side][1:]], *values))
    return rows, borders


def grown(found: DataFrame, shards: int) -> DataFrame:
    """Nodes and borders of every range shard; a row is a border if it has ``turns``."""
    names = [c.split()[0] for c in SHARD_ROW.split(", ")]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        every, turns, digest = [], None, None
        for pdf in batches:
            for own, lengths, first, members, ids in zip(*(pdf[c] for c in ("turns", "lengths", "first", "members", "ids"))):
                own = own.tolist()
                if own == turns:
                    digest.update(b"," + ids.encode())
                    every[-1][2] = min(every[-1][2], first)
                    every[-1][3] += members
                else:
                    if every:
                        every[-1][4] = digest.hexdigest()
                    turns, digest = own, hashlib.sha256(ids.encode())
                    every.append([own, lengths.tolist(), first, members, None])
        if not every:
            return
        every[-1][4] = digest.hexdigest()
        rows, borders = shard_rows(every, shard)
        for i in range(0, len(rows), 10_000):
            own = pd.DataFrame(rows[i : i + 10_000], columns=names[:11], dtype=object)
            yield own.assign(**{c: None for c in names[11:]})
        own = pd.DataFrame(borders, columns=["shard", "side", *names[11:]], dtype=object)
        yield own.assign(**{c: None for c in names[:11] if c not in own})[names]

    dealt = found.repartitionByRange(shards, "turns").sortWithinPartitions("turns", "part")
    return dealt.select("turns", "lengths", "first", "members", "ids").mapInPandas(grow, SHARD_ROW)


def merged(borders: list[dict]) -> list[tuple]:
    """Whole nodes of the border rows, and for every border place the node that it belongs to.

    A row is (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, shard,
    side, place); the first place of a node gives its columns, the others only say where it is.
    """
    nodes: list[dict] = []
    places: list[tuple[int, int, int, int]] = []
    stack: list[int] = []

    def close() -> None:
        node = nodes[stack.pop()]
        node["leaves"] = node["leaves"] or 1
        node["savings"] += (node["members"] - 1) * node["length"]
        if stack:
            up = nodes[stack[-1]]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["savings"] += node["savings"]

    path: list[int] = []
    for row in sorted(borders, key=lambda r: (list(r["turns"]), r["shard"], r["side"])):
        turns = list(row["turns"])
        same = next((i for i, (a, b) in enumerate(zip(path, turns)) if a != b), min(len(path), len(turns)))
        while len(stack) > same + 1:
            close()
        for at, depth in enumerate(row["depths"]):
            own = {c: row[c][at] for c in ("firsts", "members", "children", "leaves", "savings", "lengths", "ends")}
            if depth < len(stack):
                node = nodes[stack[depth]]
                node["first"] = min(node["first"], own["firsts"])
                for c in ("members", "children", "leaves", "savings"):
                    node[c] += own[c]
                node["ends"] = own["ends"] if node["ends"] == NO_ENDS else node["ends"]
            else:
                stack.append(len(nodes))
                nodes.append(
                    {"depth": depth, "first": own["firsts"], "length": own["lengths"], "up": stack[-2] if depth else None}
                    | {c: own[c] for c in ("members", "children", "leaves", "savings", "ends")}
                )
            places.append((stack[depth], row["shard"], row["side"], at))
        path = turns
    while stack:
        close()
    out, told = [], set()
    for i, shard, side, at in places:
        node = nodes[i]
        up = None if node["up"] is None else nodes[node["up"]]["first"]
        whole = (node["depth"], up, node["members"], node["children"], node["leaves"], node["savings"], node["ends"])
        out.append((node["first"], *(whole if i not in told else (None,) * 7), shard, side, at))
        told.add(i)
    return out


def nodes(conversations: DataFrame, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    found = stored(sequences(rebuilt(encoded(conversations)), piece), "trie-sequences")
    turns = found.agg(F.sum(F.size("turns"))).first()[0] or 0
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // shard + 1)
    both = stored(grown(found, parts), "trie-nodes")
    inner = both.where("turns IS NULL")
    schema = f"{NODES}, at_shard long, at_side long, at_place long"

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.to_dict("records")]
        out = merged(rows)
        names = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c != "ends_sha256"})

    # Two rows a shard are all that comes together here.
    edges = stored(both.where("turns IS NOT NULL").coalesce(1).mapInPandas(merge, schema), "trie-borders")
    above = edges.select(F.col("conv_id").alias("above"), "at_shard", "at_side", "at_place")
    here = (F.col("shard") == F.col("at_shard")) & (F.col("side") == F.col("at_side")) & (F.col("place") == F.col("at_place"))
    columns = [c.split()[0] for c in NODES.split(", ")]
    below = inner.where("shard IS NOT NULL").join(above, here).withColumn("parent_conv_id", F.col("above"))
    known = inner.where("shard IS NULL")
    whole = edges.where("depth IS NOT NULL")
    return known.select(columns).unionByName(below.select(columns)).unionByName(whole.select(columns))


NODES_SQL = f"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id: each byte is one step, then eight steps by one bit.
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
       lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % {REPLACED} AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
turns AS (
  SELECT c.conv_id, n.place, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.place < c.h
  UNION ALL
  SELECT c.conv_id, n.place, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.place >= c.h),
lists AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS turns,
         list(length(text) ORDER BY place) AS lengths FROM turns GROUP BY conv_id),
whole AS (
  SELECT c.conv_id, coalesce(l.turns, []) AS turns, coalesce(l.lengths, []) AS lengths
  FROM convs c LEFT JOIN lists l ON l.conv_id = c.conv_id),
prefixes AS (
  SELECT conv_id, len(turns) = d AS ends, d AS depth, turns[1:d] AS prefix, CASE WHEN d = 0 THEN 0 ELSE lengths[d] END AS size
  FROM whole, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
counted AS (SELECT prefix[1:depth - 1] AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN counted c ON c.up = l.prefix),
subtree AS (
  SELECT prefix[1:d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM marked, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked m JOIN subtree s ON s.top = m.prefix
"""
