"""Answer normalisation as column expressions; no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .numbers import python_float_text
from .pytext import DIGIT, NON_WORD, WORD, let, replace, replace_all, rstrip, strip


# ---------------------------------------------------------------- single rewrites
def fix_fractions(c: Column) -> Column:
    r"""``\frac12`` -> ``\frac{1}{2}``, ``\frac1{72}`` -> ``\frac{1}{72}``.

    A ``\frac`` with fewer than two characters behind it leaves the whole text as it is.
    """
    too_short = r"(?s)\\frac(?:[^{]?)(?=\\frac|\z)"
    both = F.regexp_replace(c, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    first = F.regexp_replace(both, r"\\frac([^{])\{", r"\\frac{$1}{")
    return F.when(c.contains("\\frac") & ~c.rlike(too_short), first).otherwise(c)


def fix_slash(c: Column) -> Column:
    r"""``a/b`` -> ``\frac{a}{b}`` for plain integers (or parts with a square root)."""
    part = r"(0|-?[1-9][0-9]*|[^/]*sqrt[^/]*)"
    return F.regexp_replace(c, rf"^{part}/{part}\z", r"\\frac{$1}{$2}")


def fix_square_root(c: Column) -> Column:
    return F.regexp_replace(c, rf"\\sqrt({WORD}+)", r"\\sqrt{$1}")


def _probe(unit: str) -> str:
    """First word (or sign) of a unit pattern; a text without it cannot hold the unit."""
    return re.split(r"[ .]", unit.strip())[0]


def strip_units(c: Column) -> Column:
    """Drop stand-alone unit words, two passes in list order; never down to nothing.

    Only units whose first word is a word of the text are tried (a leading sign need only
    occur).  Taking a unit out joins non-word characters or an edge, so no new word appears,
    and the short list gives the same result as the whole one.
    """
    places: dict[str, list[str]] = {}
    for place, unit in enumerate(V.UNIT_PATTERNS):
        places.setdefault(_probe(unit), []).append(str(place))

    def literal(texts):
        return F.split(F.lit("\n".join(texts)), "\n")

    units_of = F.map_from_arrays(literal(places), literal([",".join(p) for p in places.values()]))
    patterns = literal([rf"(?d)(^|{NON_WORD}){unit}($|{NON_WORD})" for unit in V.UNIT_PATTERNS])

    def drop(text, place):
        less = F.regexp_replace(text, F.get(patterns, place), F.lit("$1$2"))
        return F.when(less != "", less).otherwise(text)

    def run(text):
        words = F.split(text, r"[^\p{L}\p{N}_°∏]+|(?=[°∏])|(?<=[°∏])")
        known = F.concat_ws(",", F.transform(words, lambda w: F.try_element_at(units_of, w)))

        def with_known(known):
            tried = F.array_sort(F.array_distinct(F.split(known, ",").cast("array<int>")))
            return F.when(known == "", text).otherwise(
                let(tried, lambda t: F.aggregate(F.concat(t, t), text, drop))
            )

        letters = text.rlike(r"[\p{L}°∏]")
        return F.when(letters, let(known, with_known)).otherwise(text)

    return let(c, run)


def words_to_number(c: Column) -> Column:
    """English number words to digits (``twenty-five`` -> ``25``); plain digits lose leading zeros.

    The value replaces the whole text.  A text without number words stays as it is, and so does
    one that names thousand, million, billion or point twice or in a rising order.
    """
    names = list(V.NUMBER_WORDS)
    table = F.map_from_arrays(
        F.split(F.lit(" ".join(names)), " "),
        F.split(F.lit(" ".join(str(v) for v in V.NUMBER_WORDS.values())), " ").cast("array<double>"),
    )
    any_name = rf"(?i)(?:^|[-\s])(?:{'|'.join(names)})(?:[-\s]|$)"
    bad_order = (
        r"(thousand|million|billion|point)\b.*\b\1"
        r"|thousand\b.*\b(?:million|billion)|million\b.*\bbillion"
    )

    def fold(tokens):
        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("group"))

        def step(acc, token):
            n = F.try_element_at(table, token)
            big = n >= 1000
            some = F.when(acc["group"] == 0, F.lit(1.0)).otherwise(acc["group"])
            return F.struct(
                F.when(big, acc["total"] + some * n).otherwise(acc["total"]).alias("total"),
                F.when(big, F.lit(0.0))
                .when(n == 100, some * 100)
                .otherwise(acc["group"] + n)
                .alias("group"),
            )

        return F.aggregate(tokens, start, step, lambda acc: acc["total"] + acc["group"])

    def run(text):
        words = F.filter(
            F.split(F.lower(replace(text, "-", " ")), r"\s+"),
            lambda w: (w == "point") | F.map_contains_key(table, w),
        )

        def value(words):
            said = F.array_join(words, " ")
            point = F.array_position(words, "point")
            whole = F.when(point > 0, F.slice(words, F.lit(1), (point - 1).cast("int"))).otherwise(words)
            decimals = F.when(
                point > 0, F.slice(words, (point + 1).cast("int"), F.size(words))
            ).otherwise(F.array().cast("array<string>"))
            digits = F.array_join(
                F.transform(decimals, lambda w: F.try_element_at(table, w).cast("int").cast("string")), ""
            )
            single = F.forall(decimals, lambda w: F.try_element_at(table, w) <= 9)
            number = fold(whole)
            text_value = F.when(
                F.length(digits) > 0,
                python_float_text(number + F.concat(F.lit("0."), digits).try_cast("double")),
            ).otherwise(number.cast("long").cast("string"))
            return F.when(~said.rlike(bad_order) & single, text_value)

        return F.when(text.rlike(any_name), F.coalesce(let(words, value), text)).otherwise(
            F.regexp_replace(text, r"^0+(?=[0-9]+\z)", "")
        )

    return let(c, run)


# ---------------------------------------------------------------- the whole normaliser
def _open_text(c: Column) -> Column:
    """Everything before the unit words are dropped."""
    c = replace(strip(c), "\n")
    c = replace(rstrip(c, "."), "\\!")
    c = F.regexp_replace(c, r"(?d)\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}")
    c = replace_all(
        c,
        [
            ("\\end{array}", "\\end{pmatrix}"), ("bmatrix", "pmatrix"),
            ("tfrac", "frac"), ("dfrac", "frac"),
            ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge"),
            ("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}"),
        ],
    )

    def closing_label(text):
        less = strip(F.regexp_replace(text, r"(?d)\\text\{.*?\}$", ""))
        return F.when(less != "", less).otherwise(text)

    return let(c, closing_label)


def _close_text(c: Column) -> Column:
    """Everything after the unit words are dropped."""
    c = replace_all(
        c, [("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\(", ""), ("\\)", "")]
    )
    c = words_to_number(c)
    c = F.regexp_replace(c, r"(?d)\\text\{(.*?)\}", "$1")
    c = replace_all(
        c,
        [(f"{v}{op}", "") for op in ("=", "\\in", "\\to") for v in "xyz"]
        + [
            ("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}"),
            ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0."),
            ("infinity", "\\infty"),
        ],
    )
    c = let(c, lambda t: F.when(t.contains("\\infty"), t).otherwise(replace(t, "inf", "\\infty")))
    c = replace_all(c, [("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")])
    c = F.regexp_replace(c, r"(?d)\\mbox\{.*?\}", "")
    c = let(
        c,
        lambda t: F.when(t.contains("j") & ~t.contains("i"), replace(t, "j", "i")).otherwise(t),
    )
    c = F.regexp_replace(c, rf"({DIGIT}+)\.0*([^\p{{Nd}}])", "$1$2")
    c = F.regexp_replace(c, rf"(?d)({DIGIT}+)\.0*$", "$1")
    c = F.regexp_replace(c, r"^\.", "0.")
    c = F.regexp_replace(c, r"^[^=]{0,2}=([^=]*)\z", "$1")
    c = replace(fix_square_root(c), " ")
    c = let(c, fix_fractions)
    return fix_slash(c)


def normalize_answer(c: Column, skip_unit: bool = False, times: int = 1) -> Column:
    """One canonical text per answer: LaTeX spellings, units, signs, fractions, number words.

    ``times`` runs the rewrites again on their result; they stand in the plan only once.
    """

    def full(text):
        opened = _open_text(text)
        return _close_text(opened if skip_unit else strip_units(opened))

    def run(t):
        # Plain integers, choice letters and nothing at all are fixed points of every rewrite.
        return F.when(t.rlike(r"^(?:-?[1-9][0-9]*|0|[A-E])?\z"), t).otherwise(full(t))

    if times == 1:
        return let(strip(c), run)
    rounds = F.sequence(F.lit(1), F.lit(times))
    return F.aggregate(rounds, strip(c), lambda text, _: run(strip(text)))


def normalize_relations(c: Column) -> Column:
    """The light treatment of datasets whose answers stay otherwise untouched."""
    return replace_all(c, [("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")])


# ---------------------------------------------------------------- smaller cleaners
def clean_units(c: Column) -> Column:
    """Numeric clean-up: pi to 3.14, percent to ``/100``, currency and degree signs dropped."""
    c = replace(c, "\\pi", "π")
    c = F.regexp_replace(c, r"(?<![\p{Nd}}])\\?π", "3.14")
    c = F.regexp_replace(c, rf"({DIGIT})(\\?π)", r"$1*3.14")
    c = F.regexp_replace(c, r"\{(\\?π)\}", "3.14")
    c = F.regexp_replace(c, r"\*(\\?π)", "*3.14")
    return replace_all(c, [("%", "/100"), ("$", ""), ("¥", ""), ("°C", ""), (" C", ""), ("°", "")])


def clean_expression(c: Column) -> Column:
    """Expression clean-up: operator spellings, relation signs, braces of frac, log and sqrt."""
    c = replace_all(
        c,
        [
            (" . ", "."), (". ", "."), ("**", "^"), ("\\pm", ""), ("*", "\\times "),
            ("\\\\", "\\"), ("\\ne ", "\\neq "), ("!=", "\\neq"), (">=", "\\ge"),
            ("<=", "\\le"), ("≠", "\\neq"), ("dfrac", "frac"), ("tfrac", "frac"),
            ("\\$", ""), ("$", ""), ("\\%", ""), ("%", ""), ("\\!", ""),
            ("^\\circ", "\\times \\pi / 180"), ("//", "/"), ('"', ""),
        ],
    )
    for pattern, new in [
        (r"\\+", r"\\"),
        (r"(?d)\^\s?\((.*?)\)", r"^{$1}"),
        (r"\\frac\s?(\p{Nd})\s?(\p{Nd}+)", r"\\frac{$1}{$2}"),
        (r"\\log_\s?(\p{Nd})\s?(\p{Nd}+)", r"\\log_{$1}{$2}"),
        (r"(?d)\\frac\s?\{(.*?)\}\s?(\p{Nd})", r"\\frac{$1}{$2}"),
        (r"(?d)\\frac\s?(\p{Nd})\s?\{(.*?)\}", r"\\frac{$1}{$2}"),
        (r"\\sqrt\s?(\p{Nd})", r"\\sqrt{$1}"),
        (r"sqrt\s?\((\p{Nd}+)\)", r"\\sqrt{$1}"),
        (r"(?d)sqrt\s?\((.*?)\)", r"\\sqrt{$1}"),
    ]:
        c = F.regexp_replace(c, pattern, new)
    return replace_all(
        c, [(" sqrt", "\\sqrt"), ("\\left", ""), ("\\right.", ""), ("\\right", "")]
    )


def truncate_middle(c: Column, max_length: int = V.TRUNCATE_CHARS) -> Column:
    half = max_length // 2
    short = F.concat(F.left(c, F.lit(half)), F.lit("..."), F.right(c, F.lit(half)))
    return F.when(F.length(c) > max_length, short).otherwise(c)


def ran_successfully(c: Column) -> Column:
    """True when a program output shows none of the failure words."""
    lowered = F.lower(c)
    ok = F.lit(True)
    for word in V.FAILURE_WORDS:
        ok = ok & ~lowered.contains(word)
    return ok
