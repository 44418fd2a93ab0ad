"""Grading rungs: each is a boolean column over a prediction and a gold answer."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .extract import choice_letter
from .normalize import clean_expression
from .numbers import contains_digit, is_close, last_plain_number, parse_digits, parse_number
from .pytext import after_last, before, count_of, let, pieces, replace, replace_all, rstrip, strip, strip_value, without

PASSING_RUNGS = [
    "text", "choice", "number", "brackets", "tuple", "matrix", "one_sided", "value",
]


def same_text(pred: Column, gt: Column) -> Column:
    return F.lower(strip_value(pred)) == F.lower(strip_value(gt))


def same_choice(pred: Column, gt: Column) -> Column:
    return gt.isin(V.CHOICE_LETTERS) & (choice_letter(pred) == gt)


def same_number(a: Column, b: Column, tol: float = V.REL_TOL, percent: bool = True) -> Column:
    """Close to the gold number, or to it as a percentage either way round."""
    if not percent:
        return is_close(a, b, tol)
    return F.exists(F.array(b / 100, b, b * 100), lambda gold: is_close(a, gold, tol))


def _both(pred: Column, gt: Column, parse, body) -> Column:
    """Parse prediction and gold with one copy of ``parse`` and hand both values on."""
    return let(F.transform(F.array(pred, gt), parse), lambda v: body(F.get(v, F.lit(0)), F.get(v, F.lit(1))))


def _between_brackets(c: Column, opening: str, closing: str) -> Column:
    return c.startswith(opening) & c.endswith(closing)


def same_without_brackets(pred: Column, gt: Column) -> Column:
    """Equal once brackets are left out; square ones only when the pair of ends agrees."""
    peel = (_between_brackets(pred, "[", "]") & ~gt.startswith("(")) | (
        _between_brackets(pred, "(", ")") & ~gt.startswith("[")
    )

    def bare(c):
        peeled = F.when(peel, strip(c, "[]()")).otherwise(c)
        return F.lower(F.regexp_replace(peeled, "[{}()]+", ""))

    return bare(pred) == bare(gt)


def closed_form(c: Column) -> Column:
    r"""Value of a number, ``a/b`` or ``\frac{a}{b}`` with an optional sign; null otherwise."""
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
    frac = rf"^([+-]?)\\frac\{{({number})\}}\{{({number})\}}\z"
    slash = rf"^({number})/({number})\z"

    def run(t):
        def part(pattern, group):
            return F.regexp_extract(t, pattern, group).try_cast("double")

        sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
        return (
            F.when(t.contains("\\frac") & t.rlike(frac), sign * F.try_divide(part(frac, 2), part(frac, 3)))
            .when(t.contains("/") & t.rlike(slash), F.try_divide(part(slash, 1), part(slash, 2)))
            .otherwise(parse_number(t))
        )

    return let(replace(c, " "), run)


def same_value(pred: Column, gt: Column, tol: float = V.REL_TOL) -> Column:
    return _both(
        pred, gt, closed_form, lambda p, g: F.coalesce(is_close(p, g, tol), F.lit(False))
    )


def matches(pred: Column, gt: Column, tol: float, percent: bool, levels: int) -> Column:
    """All rules for an element; its own elements are looked at ``levels`` deep."""

    def by_parts(pair):
        p, g = pair["p"], pair["g"]
        flat = same_without_brackets(p, g) | same_value(p, g, tol)
        return flat | structured_rung(p, g, tol, percent, levels).isNotNull() if levels else flat

    def decide(p, g):
        return (
            F.when(p.isNotNull() & g.isNotNull(), same_number(p, g, tol, percent))
            .when(pred == "", False)
            .otherwise(let(_bare(pred, gt), by_parts))
        )

    return F.when(same_text(pred, gt) | same_choice(pred, gt), True).otherwise(_both(pred, gt, parse_digits, decide))


def _zip(left: Column, right: Column) -> Column:
    """Pairs of two arrays of one length; null when the lengths differ."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("p"), b.alias("g")))
    return F.when(F.size(left) == F.size(right), pairs)


def tuple_pairs(pred: Column, gt: Column) -> Column:
    """Elements of two tuples, points or intervals side by side; null for anything else.

    Where both are one element, all brackets that both have around it go at once.
    """
    shape = r"(?d)^[(\[].+[)\]]"

    def inner(c, cut):
        return F.substr(c, cut + 1, F.length(c) - 2 * cut)

    def around(c):
        runs = [F.length(F.regexp_extract(c, pattern, 0)) for pattern in (r"^[(\[]+", r"[)\]]+\z")]
        return F.least(*runs, F.ceil(F.length(c) / 2).cast("int") - 1)

    cut = F.when(pred.contains(",") | gt.contains(","), 1).otherwise(F.greatest(F.lit(1), F.least(around(pred), around(gt))))
    pairs = let(cut, lambda n: _zip(pieces(inner(pred, n), ","), pieces(inner(gt, n), ",")))
    return F.when(pred.rlike(shape) & gt.rlike(shape), pairs)


def set_as_matrix(gt: Column, rows_apart: bool = False) -> Column:
    r"""``{a,b}`` as a matrix text, for a prediction that is written as one.

    A single backslash stands for each comma; with ``rows_apart`` a row break does, which makes it a
    column matrix.
    """
    mark = "\\\\" if rows_apart else "\\"
    bodies = F.regexp_extract_all(strip(gt), F.lit(r"(?d)\{.*,.*\}"), F.lit(0))
    rows = F.transform(
        bodies,
        lambda m: F.concat(
            F.lit("\\begin{pmatrix}"), replace(strip(m, "{}"), ",", mark), F.lit("\\end{pmatrix}")
        ),
    )
    return F.array_join(rows, ", ")


def as_matrix(pred: Column, gt: Column) -> Column:
    """The gold answer, written as a matrix where only the prediction is one."""
    return F.when(pred.contains("pmatrix") & ~gt.contains("pmatrix"), set_as_matrix(gt)).otherwise(gt)


def _bare(pred: Column, gt: Column) -> Column:
    """Both sides without blanks around, to be bound once; gold as a matrix where only the prediction is one."""
    return F.struct(strip_value(pred).alias("p"), as_matrix(pred, strip_value(gt)).alias("g"))


def matrix_pairs(pred: Column, gt: Column) -> Column:
    r"""Cells of two matrices side by side: rows split at ``\\``, cells at ``&``.

    Blank rows do not count; null when a shape differs.
    """
    shape = r"(?s)^\\begin\{[pb]matrix\}.*\\end\{[pb]matrix\}\z"

    def rows(c):
        body = F.regexp_replace(c, r"^\\begin\{[pb]matrix\}|\\end\{[pb]matrix\}\z", "")
        texts = F.transform(pieces(body, "\\\\"), strip_value)
        return F.transform(F.filter(texts, lambda row: row != ""), lambda row: pieces(row, "&"))

    def cells(p, g):
        # Null as soon as a row is longer on one side.
        return F.when(F.size(p) == F.size(g), F.flatten(F.zip_with(p, g, _zip)))

    return F.when(pred.rlike(shape) & gt.rlike(shape), _both(pred, gt, rows, cells))


def one_sided(pred: Column, gt: Column) -> Column:
    """``x = 5`` against ``5``: a name of at most two characters before the sign is left out.

    Both sides as ``struct<p, g>``; null where the rule does not apply.
    """

    def named(c):
        return c.contains("=") & (count_of(c, "=") == 1) & (F.length(strip(before(c, "="))) <= 2)

    def pair(p, g):
        return F.struct(strip(p).alias("p"), strip(g).alias("g"))

    return F.when(named(pred) & ~gt.contains("="), pair(after_last(pred, "="), gt)).when(
        named(gt) & ~pred.contains("="), pair(pred, after_last(gt, "="))
    )


#: How deep elements are looked into.  Splitting at commas leaves none in the elements, splitting at cells
#: and rows none of their marks, and a one-sided equation leaves no equals sign: no path has more of these.
LEVELS = 3


def structured_rung(pred: Column, gt: Column, tol: float, percent: bool, levels: int = LEVELS) -> Column:
    """First of tuple, matrix and one_sided whose pairs all match by all rules; null when none does."""
    rest = F.filter(F.array(one_sided(pred, gt)), lambda pair: pair.isNotNull())
    shapes = [
        ("tuple", tuple_pairs(pred, gt)),
        ("matrix", matrix_pairs(pred, gt)),
        ("one_sided", F.when(F.size(rest) > 0, rest)),
    ]
    tried = F.array(*[F.struct(F.lit(n).alias("rung"), c.alias("pairs")) for n, c in shapes])

    def fits(s):
        every = F.forall(s["pairs"], lambda x: matches(x["p"], x["g"], tol, percent, levels - 1))
        return s["pairs"].isNotNull() & every

    found = F.get(F.filter(tried, fits), F.lit(0))["rung"]
    # Most elements have neither brackets nor signs that any shape needs.
    return F.when(pred.rlike(r"^[(\[]|^\\begin\{[pb]matrix\}|=") | gt.contains("="), found)


def grading_rung(pred: Column, gt: Column, tol: float = V.REL_TOL, percent: bool = True) -> Column:
    """Name of the first rule that decides; later, dearer rules run only when reached."""

    def structured(pair):
        p, g = pair["p"], pair["g"]
        return F.when(same_without_brackets(p, g), "brackets").otherwise(
            F.coalesce(
                structured_rung(p, g, tol, percent),
                F.when(same_value(p, g, tol), "value").otherwise("none"),
            )
        )

    def by_number(r):
        def run(p, g):
            close = F.when(same_number(p, g, tol, percent), "number").otherwise("number_differs")
            return (
                F.when(p.isNotNull() & g.isNotNull(), close)
                .when(r["pred"] == "", "empty")
                .otherwise(let(_bare(r["pred"], r["gt"]), structured))
            )

        return _both(r["pred"], r["gt"], parse_digits, run)

    def run(r):
        return (
            F.when(r["pred"].isNull() | r["gt"].isNull(), "null")
            .when(same_text(r["pred"], r["gt"]), "text")
            .when(same_choice(r["pred"], r["gt"]), "choice")
            .otherwise(by_number(r))
        )

    return let(F.struct(pred.alias("pred"), gt.alias("gt")), run)


@lru_cache(maxsize=64)
def _rung(pred: str, gt: str, tol: float, percent: bool, application: str) -> Column:
    """The rung column; a large expression, so it is built once per application."""
    return grading_rung(F.col(pred), F.col(gt), tol, percent)


def grade(
    df: DataFrame, pred: str = "pred", gt: str = "gt", tol: float = V.REL_TOL, percent: bool = True
) -> DataFrame:
    """Add ``score`` (boolean) and ``rung`` (the rule that decided).

    One CASE per row and no shuffle; prediction and gold enter the expression once each, so a
    filter on the score that Spark pushes down stays as small as the column itself.
    """
    rung = _rung(pred, gt, tol, percent, df.sparkSession.sparkContext.applicationId)
    return df.withColumn("rung", rung).withColumn("score", F.col("rung").isin(PASSING_RUNGS))


# ---------------------------------------------------------------- other comparisons
def close_by_absolute(pred: Column, gt: Column, tol: float = V.ABS_TOL) -> Column:
    """Numbers within an absolute tolerance, commas and dollar signs ignored."""
    p = replace_all(pred, [(",", ""), ("$", "")])
    g = replace_all(gt, [(",", ""), ("$", "")])
    value = F.when(p.endswith("%"), parse_number(rstrip(p, "%")) / 100).otherwise(parse_number(p))
    return F.coalesce(F.abs(value - parse_number(g)) < tol, F.lit(False))


def rough_match(text: Column, gt: Column) -> Column:
    """Last line with a digit: does any number in it that is not part of a sum match?

    Without such a line the first line is read.  A number with ``=`` anywhere behind its own
    length counts as a step of the working, not as the answer.
    """
    signs = ["+", "-", "*", "/", "^"]

    def run(lines):
        with_digit = F.filter(lines, lambda line: contains_digit(line))
        line = F.coalesce(F.try_element_at(with_digit, F.lit(-1)), F.try_element_at(lines, F.lit(1)))
        words = F.filter(F.split(line, r"[\s\p{Z}]+"), lambda w: w != "")
        return let(words, look)

    def look(words):
        def hit(w, i):
            prev_sign = F.coalesce(F.get(words, i - 1).isin(signs), F.lit(False)) & (i > 0)
            next_sign = F.coalesce(F.get(words, i + 1).isin(signs), F.lit(False))
            # The check for "=" looks at the word's own text from its position in the line on.
            rest = F.substr(w, i + 1, F.length(w))
            return (
                ~prev_sign & ~next_sign & contains_digit(w)
                & close_by_absolute(w, gt) & ~rest.contains("=")
            )

        return F.exists(F.transform(words, hit), lambda ok: ok)

    return let(F.split(text, "\n"), run)


def same_after_cleaning(pred: Column, gt: Column) -> Column:
    """Equal after expression clean-up without spaces, by value, or by the last number."""

    def cleaned(c):
        return replace_all(clean_expression(c), [(",", ""), ("$", "")])

    def decide(s):
        p, g = s["p"], s["g"]
        return (replace(p, " ") == replace(g, " ")) | F.coalesce(
            closed_form(p) == closed_form(g), F.lit(False)
        ) | F.coalesce(closed_form(last_plain_number(p)) == closed_form(g), F.lit(False))

    return F.coalesce(
        let(F.struct(cleaned(pred).alias("p"), cleaned(gt).alias("g")), decide), F.lit(False)
    )
