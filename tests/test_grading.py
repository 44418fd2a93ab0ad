"""Grading cascade: golden pairs and properties."""

import random
import re

import pytest

from markbook.functions import grading as G

PAIRS = [
    ("70,000", "70000", "number"), ("5", "5", "text"), ("(1,4.5)", "(1,\\frac{9}{2})", "tuple"),
    ("0.0833333333333333", "\\frac{1}{12}", "value"), ("50%", "0.5", "number"), ("5", "500", "number"),
    ("3", "4", "number_differs"), ("x=5", "5", "one_sided"), ("5", "k=5", "one_sided"), ("[1,2]", "(1,2)", "tuple"),
    ("the answer (b)", "B", "choice"), ("\\begin{pmatrix}1\\2\\end{pmatrix}", "{1,2}", "brackets"),
    ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "{1,2}", "none"), ("((1),2)", "((1.0),2)", "tuple"), ("(((1.0)))", "[((1))]", "tuple"),
    ("(x=1.0,y=2)", "(1,2.0)", "tuple"), ("((1,2),3)", "((1, 2),3.0)", "tuple"), ("((1,2),3)", "((1,4),3)", "none"),
    ("\\begin{pmatrix}(1,2.0]&3\\end{pmatrix}", "\\begin{pmatrix}(1.0,2]&3\\end{pmatrix}", "matrix"),
    ("x=\\begin{bmatrix}(1,2.0]&3\\end{bmatrix}", "\\begin{bmatrix}(1.0,2]&3\\end{bmatrix}", "one_sided"),
    ("(\\begin{pmatrix}1.0&x=2\\end{pmatrix},3)", "(\\begin{pmatrix}1&2.0\\end{pmatrix},3.0)", "tuple"),
    ("k=((1.0),[2])", "((1),[2.0])", "one_sided"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1.0&2\\\\3&\\frac{8}{2}\\\\\\end{pmatrix}", "matrix"),
    ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}", "none"),
    ("", "5", "empty"), (None, "5", "null"), ("5", None, "null"), ("abc", "abd", "none"), ("inf", "5", "number_differs"),
    ("-\\frac{1}{2}", "-0.5", "value"), ("(0.6,2.6667]", "(\\frac{3}{5},\\frac{8}{3}]", "tuple"), ("100.005", "100", "number"),
    ("nan", "nan ", "text"), ("NaN", "1", "number_differs"), ("name=5", "5", "none"), ("1/0", "2", "none"),
]


def test_rungs(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(PAIRS)], "i int, pred string, gt string")
    rows = G.grade(df).orderBy("i").collect()
    assert [r["rung"] for r in rows] == [want for *_, want in PAIRS]
    assert [r["score"] for r in rows] == [want in G.PASSING_RUNGS for *_, want in PAIRS]


def test_values_are_not_searched_for_blanks(spark):
    """Blanks are stripped behind a look at both ends, and never from a whole expression again and again."""
    df = spark.createDataFrame([("1", "2")], "pred string, gt string")
    plan = df.select(G.grading_rung(df["pred"], df["gt"]))._jdf.queryExecution().analyzed().toString()
    unguarded = len(re.findall(r"trim\(", plan)) - len(re.findall(r"THEN b?trim\(", plan))
    assert unguarded < 200  # 346 when every rule stripped both sides anew


@pytest.mark.parametrize("blank", [" ", "\t", "\u3000", "\x85", "\x1c", "\u2029\xa0"])
def test_blanks_around_values(spark, blank):
    pairs = [
        ("7.0", "7", "number"), ("1_0", "10.0", "number"), ("aB", "Ab", "text"), ("\\frac{1}{2}", "1/2", "value"), ("x", "y", "none"),
        ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1.0&2\\\\3&4\\end{pmatrix}", "matrix"),
        ("\\begin{pmatrix}1\\2\\end{pmatrix}", "{1,2}", "brackets"), ("(x=1.0,y=2)", "(1,2.0)", "tuple"),
    ]
    rows = [(i, f"{blank}{p}{blank}", f"{g}{blank}") for i, (p, g, _) in enumerate(pairs)]
    got = G.grade(spark.createDataFrame(rows, "i int, pred string, gt string")).orderBy("i").collect()
    assert [r["rung"] for r in got] == [want for *_, want in pairs]


def test_without_percent(spark):
    df = spark.createDataFrame([("5", "500")], "pred string, gt string")
    assert G.grade(df, percent=False).first()["rung"] == "number_differs"


def test_same_text_is_right(spark):
    texts = ["a", "1,2", "{x}", "\\frac12", " ", "答"]
    df = spark.createDataFrame([(t, t) for t in texts], "pred string, gt string")
    assert all(r["score"] for r in G.grade(df).collect())


@pytest.mark.parametrize(
    "pred,gt,same",
    [("5%", "0.05", True), ("1,000", "1000", True), ("1.0005", "1", True), ("1.002", "1", False), (None, "1", False), ("x", "1", False)],
)
def test_absolute(spark, pred, gt, same):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(pred, gt)], "p string, g string")
    assert df.select(G.close_by_absolute(F.col("p"), F.col("g"))).first()[0] is same


def test_rough(spark):
    from pyspark.sql import functions as F

    rows = [("a 3\nb 5 end", "5", True), ("3 + 5", "5", False), ("5 = 5", "5", True), ("no digits", "5", False), ("is $5", "5", True)]
    df = spark.createDataFrame(rows, "p string, g string, want boolean")
    for r in df.select("p", "want", G.rough_match(F.col("p"), F.col("g")).alias("got")).collect():
        assert r["got"] == r["want"], r["p"]


def test_distinct_pairs_give_the_same(spark):
    from markbook.operators.completions import grade_distinct

    df = spark.createDataFrame([(p, g) for p, g, _ in PAIRS] * 3, "pred string, gt string")
    assert sorted(map(str, grade_distinct(df).collect())) == sorted(
        map(str, G.grade(df).select("pred", "gt", "score", "rung").collect())
    )


def plain_equal(p, g):
    """The cascade by recursion, with numbers, brackets and closed forms as its only values."""
    from fractions import Fraction

    def number(x):
        t = x.strip().replace(",", "")
        try:
            return float(t[:-1].rstrip("\\")) / 100 if t.endswith("%") else float(t)
        except ValueError:
            return None

    def value(x):
        t = x.replace(" ", "")
        if m := re.fullmatch(r"(-?)\\frac\{(\d+)\}\{(\d+)\}", t):
            return float(Fraction(int(m[2]), int(m[3]))) * (-1 if m[1] else 1) if int(m[3]) else None
        if m := re.fullmatch(r"(-?\d+)/(\d+)", t):
            return int(m[1]) / int(m[2]) if int(m[2]) else None
        return None if "%" in t or "," in t else number(t)

    def close(a, b):
        return abs(a - b) <= 1e-4 * max(abs(a), abs(b))

    if p.strip().lower() == g.strip().lower():
        return True
    a, b = number(p), number(g)
    if a is not None and b is not None:
        return any(close(a, x) for x in (b / 100, b, b * 100))
    if not p:
        return False
    p, g = p.strip(), g.strip()
    if "pmatrix" in p and "pmatrix" not in g:
        g = ", ".join("\\begin{pmatrix}" + m.strip("{}").replace(",", "\\") + "\\end{pmatrix}" for m in re.findall(r"\{.*,.*\}", g))
    x, y = p, g
    if (p[:1] == "[" and p[-1:] == "]" and g[:1] != "(") or (p[:1] == "(" and p[-1:] == ")" and g[:1] != "["):
        x, y = p.strip("[]()"), g.strip("[]()")
    x, y = (re.sub(r"[{}()]", "", t).lower() for t in (x, y))
    if x == y:
        return True
    if all(re.match(r"[(\[].+[)\]]", t) for t in (p, g)):
        one, two = p[1:-1].split(","), g[1:-1].split(",")
        if len(one) == len(two) and all(map(plain_equal, one, two)):
            return True
    shape = r"(?s)\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}"
    if (m := re.fullmatch(shape, p)) and (n := re.fullmatch(shape, g)):
        rows = [[r.strip().split("&") for r in t[1].split("\\\\") if r.strip()] for t in (m, n)]
        if [len(r) for r in rows[0]] == [len(r) for r in rows[1]]:
            if all(plain_equal(c, d) for r, s in zip(*rows) for c, d in zip(r, s)):
                return True
    if p.count("=") == 1 and len(p.split("=")[0].strip()) <= 2 and "=" not in g:
        if plain_equal(p.split("=")[1], g):
            return True
    elif g.count("=") == 1 and len(g.split("=")[0].strip()) <= 2 and "=" not in p:
        if plain_equal(p, g.split("=")[1]):
            return True
    a, b = value(p), value(g)
    return a is not None and b is not None and close(a, b)


def test_nested_answers_against_recursion(spark):
    draw = random.Random(11)
    same = [["1", "1.0", "\\frac{2}{2}"], ["2", "4/2", "2.0"], ["50%", "0.5", "1/2"], ["ab", "AB"], ["7", "7.00"]]

    def pair(depth):
        kind = draw.randrange(6) if depth else 0
        if kind <= 1:
            group = draw.choice(same)
            p = draw.choice(group)
            return p, draw.choice(group) if draw.random() < 0.93 else "9"
        if kind == 2:
            p, g = pair(depth - 1)
            return (f"x={p}", g) if draw.random() < 0.5 else (p, f"y = {g}")
        parts = [pair(depth - 1) for _ in range(draw.choice([1, 1, 2, 3]))]
        if kind <= 4:
            left, right = draw.choice(["()", "[)", "[]", "(]"]), draw.choice(["()", "[]"])
            return tuple(b[0] + ",".join(x[i] for x in parts) + b[1] for i, b in ((0, left), (1, right)))
        mark = draw.choice(["&", "\\\\"])
        return tuple(f"\\begin{{{m}matrix}}" + mark.join(x[i] for x in parts) + f"\\end{{{m}matrix}}" for i, m in ((0, "p"), (1, "b")))

    rows = [pair(draw.randrange(1, 4)) for _ in range(3000)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(rows)], "i int, pred string, gt string")
    got = {r.i: r.score for r in G.grade(df).collect()}
    wrong = [(p, g, got[i]) for i, (p, g) in enumerate(rows) if got[i] != plain_equal(p, g)]
    assert wrong == []
    assert 500 < sum(got.values()) < 2900
