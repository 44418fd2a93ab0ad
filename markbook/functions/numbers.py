"""Reading numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import DIGIT, SPACE, find_all, last_of, let, replace, strip_value, without

_RUN = r"[0-9]+(?:_[0-9]+)*"
_BLANKS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE) + "]*+"
NUMBER_TEXT = (
    rf"(?i)^{_BLANKS}[+-]?(?:(?:{_RUN}(?:\.(?:{_RUN})?)?|\.{_RUN})(?:e[+-]?{_RUN})?|inf|infinity|nan){_BLANKS}\z"
)


def parse_number(c: Column) -> Column:
    """Text to double under Python's rules; null when it is not a number.

    The pattern guards the cast: Spark alone would read ``1d`` and refuse ``1_000``.  It allows blanks
    around, so that only numbers are stripped.
    """
    return let(c, _number)


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), without(strip_value(text), "_").try_cast("double"))


def is_number(c: Column) -> Column:
    return parse_number(replace(c, " ")).isNotNull()


def contains_digit(c: Column) -> Column:
    return c.rlike(DIGIT)


def parse_digits(c: Column) -> Column:
    """Number with thousands commas, or a percentage (``50%`` and ``50\\%``) as a fraction."""

    def run(text):
        percent = F.when(text.endswith("%"), parse_number(F.regexp_replace(text, r"\\?%\z", "")) / 100)
        return F.coalesce(_number(text), percent)

    return let(replace(c, ","), run)


def is_close(a: Column, b: Column, tol: float = 1e-4) -> Column:
    """Relative closeness; NaN is close to nothing, an infinity only to itself."""
    inf = F.lit(float("inf"))

    def decide(v):
        a, b = v["a"], v["b"]
        return (
            F.when(F.isnan(a) | F.isnan(b), False)
            .when(a == b, True)
            .when((F.abs(a) == inf) | (F.abs(b) == inf), False)
            .otherwise(F.abs(a - b) <= F.lit(tol) * F.greatest(F.abs(a), F.abs(b)))
        )

    return let(F.struct(a.alias("a"), b.alias("b")), decide)


def last_number(c: Column) -> Column:
    """Last signed number once commas are gone, or the empty string."""
    found = find_all(replace(c, ","), rf"-?{DIGIT}*\.?{DIGIT}+")
    return F.coalesce(last_of(found), F.lit(""))


def last_plain_number(c: Column) -> Column:
    """Last number that starts with a digit (``12.`` keeps its point), or the empty string."""
    found = find_all(replace(c, ","), rf"-?{DIGIT}+\.?{DIGIT}*")
    return F.coalesce(last_of(found), F.lit(""))


def python_float_text(c: Column) -> Column:
    """Text of a double as Python prints it: the fewest digits that read back as the same number.

    Plain from 1e-4 up to below 1e16, else with an exponent of at least two digits.
    """

    def digits_of(number):
        texts = [F.format_string(f"%.{n}e", number) for n in (14, 15, 16)]
        fewest = F.coalesce(*[F.when(t.cast("double") == number, t) for t in texts[:2]], texts[2])
        return let(fewest, lambda t: shown(t, number))

    def shown(text, number):
        digits = F.rtrim(F.concat(F.regexp_extract(text, r"([0-9])\.", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)), F.lit("0"))
        return let(
            F.struct(digits.alias("d"), F.regexp_extract(text, r"e(.*)\z", 1).cast("int").alias("e")),
            lambda s: F.concat(F.when(text.startswith("-"), "-").otherwise(""), placed(s["d"], s["e"])),
        )

    def placed(d, e):
        after = F.substr(d, e + 2)
        whole = F.concat(F.rpad(F.substr(d, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.when(after == "", "0").otherwise(after))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        rest = F.substr(d, F.lit(2))
        mantissa = F.concat(F.left(d, F.lit(1)), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(e)))
        return (
            F.when(d == "", "0.0").when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small)
            .otherwise(F.concat(mantissa, power))
        )

    def run(number):
        return (
            F.when(F.isnan(number), "nan")
            .when(number == float("inf"), "inf")
            .when(number == float("-inf"), "-inf")
            .when(number.isNotNull(), digits_of(number))
        )

    return let(c.cast("double"), run)


def evaluated_text(c: Column) -> Column:
    r"""Value of a number, ``a/b`` or ``\frac{a}{b}`` as Python shows it; null for anything else."""
    number = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
    whole, slash = r"^[+-]?[0-9]{1,18}\z", rf"^{number}/{number}\z"
    frac = rf"^([+-]?)\\frac\{{{number}\}}\{{{number}\}}\z"

    def ratio(a, b, exact):
        value = F.try_divide(a.try_cast("double"), b.try_cast("double"))
        return F.when(exact & (value == F.floor(value)), value.cast("decimal(38,0)").cast("string")).otherwise(python_float_text(value))

    def run(t):
        part = lambda pattern, group: F.regexp_extract(t, pattern, group)
        top = F.concat(part(frac, 1), part(frac, 2))
        return (
            F.when(t.rlike(whole), t.try_cast("long").cast("string"))
            .when(t.rlike(slash), ratio(part(slash, 1), part(slash, 2), ~t.contains(".")))
            .when(t.rlike(frac), ratio(top, part(frac, 3), ~t.contains(".")))
            .when(t.rlike(rf"^{number}\z"), python_float_text(t.try_cast("double")))
        )

    return let(c, run)


def percent_text_to_decimal(c: Column) -> Column:
    """Each ``12.5%`` in the text becomes its decimal value (``0.125``)."""
    pattern = r"[0-9]+(?:\.[0-9]+)?%"
    found = find_all(c, pattern)

    def value(text):
        return python_float_text(F.regexp_replace(text, "%", "").cast("double") / 100)

    swap = F.aggregate(found, c, lambda acc, m: F.replace(acc, m, value(m)))
    return F.when(c.rlike(pattern), swap).otherwise(c)
