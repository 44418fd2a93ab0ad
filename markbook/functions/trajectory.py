"""Interleaved rationale / program / output texts as arrays of blocks.

A text is cut at its ```` ```python ```` lines once.  Each piece after the first starts with a program; its first
two closing fences end the program and the output, and what follows is rationale.  Pieces don't depend on one
another, so the work is linear in the length of the text, however many fences it has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import output_blocks  # noqa: F401  (the output reader lives with the extractors)
from .normalize import ran_successfully
from .pytext import SPACE, find_all, let, strip

INVALID_PROGRAM = "raise ValueError('Invalid trajectory')"

# In a text with a line break put before it, every line starts with one.
_PROGRAM = r"\n```python(?=\n|\z)"
_CLOSED = r"\n```(?=\n|\z)"
_OUTPUT = r"^(?:\n```output[^\n]*)+"
_BLOCKS = "array<struct<role:string,content:string>>"
_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in SPACE if c != "\n")
_PRINT = rf"\n[{_BLANK}]*print\([^\n]*"


def _ended(lines: Column) -> Column:
    """Lines (each with a break before it) as text in which each has one behind it."""
    return F.when(lines == "", "").otherwise(F.concat(_open(lines), F.lit("\n")))


def _open(lines: Column) -> Column:
    """Lines as text whose last one has no break behind it."""
    return F.substr(lines, F.lit(2))


def _pieces(c: Column) -> Column:
    return F.split(F.concat(F.lit("\n"), c), _PROGRAM)


def _segments(pieces: Column) -> Column:
    """For every program: its lines, those of its output and of the rationale behind, and if all is well.

    ``fences`` counts the closing ones, up to two; without the second one the text has to end.
    """

    def run(piece, i):
        def read(parts):
            output = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), _OUTPUT, "")
            fences = F.size(parts) - 1
            last = i == F.size(pieces) - 2
            started = (fences == 0) | (parts[0] != "")
            return let(
                output,
                lambda o: F.struct(
                    parts[0].alias("program"),
                    o.alias("output"),
                    F.get(parts, F.lit(2)).alias("rest"),
                    fences.alias("fences"),
                    last.alias("last"),
                    ((last | (fences == 2)) & started & ~o.contains("\n```output")).alias("ok"),
                ),
            )

        return let(F.split(piece, _CLOSED, 3), read)

    return F.transform(F.slice(pieces, 2, F.size(pieces)), run)


def trajectory(c: Column) -> Column:
    """Text to ``array<struct<role, content>>``; null when the fences do not nest properly."""

    def block(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def blocks(s):
        """Program, output and rationale of a segment; a block without content stays only if it is closed."""
        kept = F.array(
            F.struct((s["fences"] > 0).alias("closed"), block("program", F.when(s["fences"] > 0, _ended(s["program"])).otherwise(_open(s["program"]))).alias("b")),
            F.struct((s["fences"] > 1).alias("closed"), block("output", F.when(s["fences"] > 1, _ended(s["output"])).otherwise(_open(s["output"]))).alias("b")),
            F.struct(F.lit(False).alias("closed"), block("rationale", F.coalesce(F.when(s["last"], _open(s["rest"])).otherwise(_ended(s["rest"])), F.lit(""))).alias("b")),
        )
        return F.transform(F.filter(kept, lambda k: k["closed"] | (k["b"]["content"] != "")), lambda k: k["b"])

    def run(pieces):
        head = F.when(F.size(pieces) == 1, _open(pieces[0])).otherwise(_ended(pieces[0]))
        first = F.when(head != "", F.array(block("rationale", head))).otherwise(F.array().cast(_BLOCKS))
        return let(
            _segments(pieces),
            lambda own: F.when(F.forall(own, lambda s: s["ok"]), F.concat(first, F.flatten(F.transform(own, blocks)))),
        )

    return let(_pieces(c), run)


def trajectory_text(blocks: Column) -> Column:
    """Blocks back to text."""

    def render(b):
        fenced = F.concat(
            F.lit("```"), F.when(b["role"] == "program", "python").otherwise("output"),
            F.lit("\n"), b["content"], F.lit("```\n"),
        )
        return F.when(b["role"].isin("program", "output"), fenced).otherwise(b["content"])

    return F.array_join(F.transform(blocks, render), "")


def programs(c: Column, last_only: bool = False) -> Column:
    """The successful programs of a text as one program.

    A program counts when the output behind it shows no failure, or when nothing follows it.
    Failed ones leave only their import lines, put before the first program; print lines stay
    in the last program only.
    """

    def mark(s):
        # A program that the text leaves open is there if it has content, an open output likewise.
        alone = s["last"] & (_open(s["output"]) == "") & (s["fences"] < 2)
        return F.struct(
            F.when(s["fences"] > 0, _ended(s["program"])).otherwise(_open(s["program"])).alias("content"),
            (alone | ran_successfully(strip(s["output"]))).alias("good"),
        )

    def imports_of(b):
        return find_all(F.concat(F.lit("\n"), b["content"]), r"\n((?:import|from)[^\n]*)", 1)

    def quiet(text):
        return F.substr(F.regexp_replace(F.concat(F.lit("\n"), text), _PRINT, ""), F.lit(2))

    def assemble(marked):
        kept = F.transform(F.filter(marked, lambda b: b["good"]), lambda b: b["content"])
        imports = F.flatten(F.transform(F.filter(marked, lambda b: ~b["good"]), imports_of))
        head = F.when(F.size(imports) > 0, F.concat(F.array_join(imports, "\n"), F.lit("\n"))).otherwise(F.lit(""))

        def finish(some):
            last = F.size(some["kept"]) - 1

            def one(text, i):
                full = F.when(i == 0, F.concat(some["head"], text)).otherwise(text)
                return F.when(i < last, quiet(full)).otherwise(full)

            if last_only:
                return one(some["kept"][last], last)
            return F.array_join(F.transform(some["kept"], one), "\n")

        some = F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept)
        return let(F.struct(some.alias("kept"), head.alias("head")), finish)

    def run(own):
        there = F.filter(F.transform(own, mark), lambda b: b["content"] != "")
        return F.when(F.forall(own, lambda s: s["ok"]), let(there, assemble)).otherwise(F.lit(INVALID_PROGRAM))

    return F.when(c.isNotNull(), let(let(_pieces(c), _segments), run))
