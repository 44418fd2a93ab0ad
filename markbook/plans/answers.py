"""Answer extraction, normalisation and grading rungs over composed completions.

Each SQL states the expected answer directly from the numbers a text was composed of, so it does
not share any rule with the Spark side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import grading as G
from ..functions import normalize as N
from ..functions import numbers as U
from ..functions import trajectory as T
from ..operators import completions as C
from .fixtures import LINES, by_kind, lines, q
from .registry import query, table

S = f"WITH {LINES}"


def texts(spark, folder, branches, otherwise, name="text"):
    return lines(spark, folder).withColumn(name, by_kind(branches, otherwise))


# ---------------------------------------------------------------- extraction
def extraction_texts():
    return ({1: ["final answer is $", q(), "$. I hope it is correct."],
         2: ["So \\boxed{", q(), "} holds."],
         3: ["Sum it up. The answer is ", q(), "."],
         4: ["My final answer is ", q(), " miles"],
         5: ["答案是 ", q(), "\n\nnext"]},
        ["From 3 and 4 we get ", q(), ",000 in total"])


@query("ans1_extract_answer", S + """ SELECT idx, kind, q, part,
 CASE WHEN kind <= 5 THEN CAST(q AS VARCHAR) ELSE concat(q, '000') END AS answer FROM li""")
def ans1(spark, folder):
    df = texts(spark, folder, *extraction_texts())
    return df.select("idx", "kind", "q", "part", X.extract_answer(F.col("text"), "math").alias("answer"))


@query("ans2_boxed", S + r""" SELECT idx, kind, part,
 CASE WHEN kind <= 2 THEN concat(chr(92), 'frac{', q, '}{', supp, '}')
      WHEN kind = 3 THEN concat('{', q, '}') WHEN kind = 4 THEN concat('a{', q, '}{ open')
      WHEN kind = 5 THEN CAST(q AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS body FROM li""")
def ans2(spark, folder):
    df = texts(spark, folder, {
        1: ["x \\boxed{\\frac{", q(), "}{", q("supp"), "}} and {more}"],
        2: ["first \\boxed{1} then \\boxed{\\frac{", q(), "}{", q("supp"), "}}"],
        3: ["\\boxed{{", q(), "}} end"],
        4: ["\\boxed{a{", q(), "}{ open"],
        5: ["boxed ", q(), " $ tail"],
    }, ["\\boxed{", q(), "}."])
    return df.select("idx", "kind", "part", X.boxed(F.col("text")).alias("body"))


@query("ans3_last_number", r"""SELECT doc_id,
 coalesce(regexp_extract_all(replace(text, ',', ''), '-?[0-9]*\.?[0-9]+')[-1], '') AS number FROM documents""")
def ans3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", U.last_number(F.col("text")).alias("number"))


def letter(column="part", base=5):
    return F.substr(F.lit("ABCDE"), (F.col(column) % base + 1).cast("int"), F.lit(1))


LETTER = "substr('ABCDE', CAST(part % 5 AS INTEGER) + 1, 1)"
OTHER = "substr('ABCDE', CAST(supp % 5 AS INTEGER) + 1, 1)"


@query("ans4_choice_answer", S + f""" SELECT idx, kind, part, supp,
 CASE WHEN kind = 6 THEN concat('none ', q) ELSE {LETTER} END AS choice FROM li""")
def ans4(spark, folder):
    a, b = letter(), letter("supp")
    df = texts(spark, folder, {
        1: ["So the answer is (", a, "). Option ", b, " is wrong."],
        2: ["Not ", b, ", rather ", a, "."],
        3: ["choice is ", a, "\n\nQ: next\nchoice is ", b],
        4: ["The answer is: ", F.lower(a), "\n"],
        5: ["(", a, ")"],
        6: ["none ", q(), "./"],
    }, ["we pick ", b, " then ", a])
    return df.select("idx", "kind", "part", "supp", X.choice_answer(F.col("text")).alias("choice"))


@query("ans4_choice_letter_documents", r"""SELECT doc_id, coalesce(
   regexp_extract_all(upper(text), '(?:^|[^\p{L}\p{N}_])([A-E])(?:$|[^\p{L}\p{N}_])', 1)[-1], '') AS choice
 FROM (SELECT doc_id, regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') AS text FROM documents)""")
def ans4_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = X.last_of(X.find_all(F.upper(F.col("text")), X.LETTER_CHOICE))
    return docs.select("doc_id", F.coalesce(found, F.lit("")).alias("choice"))


@query("ans5_multi_choice", S + f""" SELECT idx, kind, part, supp,
 CASE WHEN kind <= 4 THEN {LETTER} ELSE 'placeholder' END AS choice FROM li""")
def ans5(spark, folder):
    a, b = letter(), letter("supp")
    df = texts(spark, folder, {
        1: ["the answer is (", a, ")"], 2: ["the choice is ", a, "."],
        3: ["Answer is ", F.lower(a), "\nProblem: answer is ", b],
        4: ["answer is ", a, ", not ", b], 5: ["Problem: answer is ", a],
    }, ["I guess ", a])
    return df.select("idx", "kind", "part", "supp", X.multi_choice(F.col("text")).alias("choice"))


@query("ans6_typed_answer", S + """ SELECT idx, kind, part, q,
 CASE WHEN kind = 1 THEN 'True' WHEN kind = 2 THEN 'False' WHEN kind = 3 THEN concat('(b) ', q)
      WHEN kind = 4 THEN CASE WHEN q % 100 = 0 THEN CAST(q // 100 AS VARCHAR) ELSE CAST(q / 100.0 AS DOUBLE)::VARCHAR END
      WHEN kind = 5 THEN CAST(q * 3 AS VARCHAR)
      ELSE CAST(q AS VARCHAR) END AS answer FROM li""")
def ans6(spark, folder):
    df = texts(spark, folder, {
        1: ["Yes, ", q()], 2: ["that is False ", q()], 3: ["(b) ", q()],
        4: ["x = ", q(), "%"], 5: ["so x = ", (F.col("q") * 12).cast("string"), "/4"],
    }, ["x = ", q(), " kg"])
    return df.select("idx", "kind", "part", "q", X.typed_answer(F.col("text")).alias("answer"))


@query("ans7_edge_trims", S + """ SELECT idx, kind, part, CAST(q AS VARCHAR) AS answer FROM li""")
def ans7(spark, folder):
    df = texts(spark, folder, {
        1: [":", q(), "."], 2: [q(), "/"], 3: [q(), "./"[0:1]], 4: ["\n  ", q(), "\n \n"],
        5: [":", q(), "/"],
    }, [":", q(), "/", "."])
    return df.select("idx", "kind", "part", X.trim_answer(F.col("text")).alias("answer"))


# ---------------------------------------------------------------- completions
@query("cmp1_remove_prompt", S + " SELECT idx, kind, part, concat('gets ', q) AS code FROM li")
def cmp1(spark, folder):
    df = lines(spark, folder).withColumn("prompt", F.concat(F.lit("Q: part "), q("part"), F.lit("?\nA:")))
    text = F.concat("prompt", F.lit(" no. "), F.col("prompt"), F.lit("\n gets "), q(), F.lit(" \n"))
    return df.select("idx", "kind", "part", X.completion_text(text, F.col("prompt")).alias("code"))


@query("cmp2_stop_words", S + " SELECT idx, kind, part, concat('It is ', q) AS code FROM li")
def cmp2(spark, folder):
    df = texts(spark, folder, {
        1: ["It is ", q(), "</s> more"], 2: ["It is ", q(), " <|im_end|><|endoftext|>"],
        3: ["It is ", q(), "\n\nQuestion: again?</s>"], 4: ["It is ", q(), "<|endoftext|> x </s>"],
    }, ["It is ", q()])
    return df.select("idx", "kind", "part", X.cut_at_stop_words(F.col("text"), C.stop_words_for("cot")).alias("code"))


@query("cmp4_repair_choice", S + f""" SELECT idx, kind, part,
 CASE WHEN kind <= 2 THEN {LETTER} WHEN kind = 3 THEN 'AC' ELSE CAST(q AS VARCHAR) END AS pred FROM li""")
def cmp4(spark, folder):
    a = letter()
    df = lines(spark, folder)
    gt = F.when(F.col("kind") <= 2, a).when(F.col("kind") == 3, "AC").otherwise(q())
    pred = F.when(F.col("kind") == 1, a).when(F.col("kind") == 3, "A, and C").otherwise(q())
    code = F.concat(F.lit("The answer is ("), a, F.lit(")"))
    return df.select("idx", "kind", "part", X.repair_choice(pred, gt, code).alias("pred"))


@query("cmp5_route_by_prompt_type", S + """ SELECT idx, kind, part,
 CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN NULL ELSE CAST(q AS VARCHAR) END AS from_text,
 CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN NULL WHEN kind <= 3 THEN concat(q + 1) ELSE '' END AS from_program
 FROM li""")
def cmp5(spark, folder):
    out = F.concat(F.lit("```output\n1\n```\nso\n```output\n"), (F.col("q") + 1).cast("string"), F.lit("\n```\n"))
    df = lines(spark, folder).withColumn(
        "code",
        F.when(F.col("kind") == 6, "").when(F.col("kind") == 7, "error").otherwise(
            F.concat(F.when(F.col("kind") <= 3, out).otherwise(""), F.lit("the answer is "), q(), F.lit("."))
        ),
    )
    return df.select(
        "idx", "kind", "part", X.predict(F.col("code"), "cot", "math").alias("from_text"),
        X.predict(F.col("code"), "program_only", "math").alias("from_program"),
    )


# ---------------------------------------------------------------- normalisation
def spelling_texts():
    return ({1: ["\\dfrac", q(), "{7}"], 2: [" x = ", q(), " "], 3: [q(), ".000\\%"], 4: ["\\$", q(), "."],
         5: ["\\left(", q(), ",\\!", q("supp"), "\\right)"], 6: ["\\sqrt", q(), "^{\\circ}"]},
        [q(), "/", q("supp")])


@query("nrm1_normalize_answer", S + r""" SELECT idx, kind, part, supp,
 CASE kind WHEN 1 THEN CASE WHEN q < 10 THEN concat(chr(92), 'frac{', q, '}{7}')
                            ELSE concat(chr(92), 'frac{', q // 10, '}{', q % 10, '}{7}') END
   WHEN 2 THEN CAST(q AS VARCHAR) WHEN 3 THEN CAST(q AS VARCHAR) WHEN 4 THEN CAST(q AS VARCHAR)
   WHEN 5 THEN concat('(', q, ',', supp, ')') WHEN 6 THEN concat(chr(92), 'sqrt{', q, '}')
   ELSE concat(chr(92), 'frac{', q, '}{', supp, '}') END AS answer FROM li""")
def nrm1(spark, folder):
    df = texts(spark, folder, *spelling_texts())
    return df.select("idx", "kind", "part", "supp", N.normalize_answer(F.col("text")).alias("answer"))


@query("nrm2_strip_units", S + " SELECT idx, kind, part, concat(q, CASE kind WHEN 6 THEN 'xyz' ELSE '' END) AS answer FROM li")
def nrm2(spark, folder):
    df = texts(spark, folder, {
        1: [q(), " miles"], 2: [q(), " sq cm"], 3: [q(), " square feet per hour"], 4: [q(), " dollars kg"],
        5: [q(), " degrees"], 6: [q(), " xyz"],
    }, [q(), " cu . m"])
    less = N.replace(F.regexp_replace(N.strip_units(F.col("text")), "dollars", ""), " ")
    return df.select("idx", "kind", "part", less.alias("answer"))


@query("nrm3_fractions", S + r""" SELECT idx, kind, part, CASE
   WHEN kind <= 2 THEN concat(chr(92), 'frac{', q % 10, '}{', supp % 10, '}')
   WHEN kind <= 4 THEN concat(chr(92), 'frac{', q % 10, '}{', supp, '}x')
   WHEN kind = 5 THEN concat(chr(92), 'frac', q % 10) ELSE concat(chr(92), 'frac{', q, '}{', supp, '}') END AS answer FROM li""")
def nrm3(spark, folder):
    a, b = (F.col("q") % 10).cast("string"), (F.col("supp") % 10).cast("string")
    pair, braced = ["\\frac", a, b], ["\\frac", a, "{", q("supp"), "}x"]
    df = texts(spark, folder, {1: pair, 2: pair, 3: braced, 4: braced, 5: ["\\frac", a]},
               ["\\frac{", q(), "}{", q("supp"), "}"])
    return df.select("idx", "kind", "part", N.fix_fractions(F.col("text")).alias("answer"))


@query("nrm4_slash", S + r""" SELECT idx, kind, part, CASE
   WHEN kind <= 2 THEN concat(chr(92), 'frac{', q, '}{', supp, '}') WHEN kind = 3 THEN concat('0', q, '/', supp)
   WHEN kind = 4 THEN concat(chr(92), 'frac{sqrt(', q, ')}{2}') WHEN kind = 5 THEN concat(q, '/2/', supp)
   ELSE concat(q, '.5/2') END AS answer FROM li""")
def nrm4(spark, folder):
    plain = [q(), "/", q("supp")]
    df = texts(spark, folder, {1: plain, 2: plain, 3: ["0", q(), "/", q("supp")],
               4: ["sqrt(", q(), ")/2"], 5: [q(), "/2/", q("supp")]}, [q(), ".5/2"])
    return df.select("idx", "kind", "part", N.fix_slash(F.col("text")).alias("answer"))


@query("nrm5_square_roots", S + r""" SELECT idx, kind, part,
 concat(q, chr(92), 'sqrt{', supp, '}') AS answer FROM li""")
def nrm5(spark, folder):
    df = texts(spark, folder, {1: [q(), "\\sqrt", q("supp")]}, [q(), "\\sqrt{", q("supp"), "}"])
    return df.select("idx", "kind", "part", N.fix_square_root(F.col("text")).alias("answer"))


TENS = ["", "", "twenty", "thirty", "forty", "fifty"]
ONES = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def spoken(number):
    """Words of 20..59 for a column (the only ones the query says)."""
    tens = F.element_at(F.array(*[F.lit(t) for t in TENS]), (F.floor(number / 10) + 1).cast("int"))
    ones = F.element_at(F.array(*[F.lit(o) for o in ONES]), (number % 10 + 1).cast("int"))
    return F.concat(tens, F.when(ones != "", F.concat(F.lit("-"), ones)).otherwise(""))


@query("nrm6_number_words", S + """ SELECT idx, kind, part, CASE
   WHEN kind <= 2 THEN CAST(20 + q % 40 AS VARCHAR) WHEN kind = 3 THEN CAST(1000 * (20 + q % 40) + 305 AS VARCHAR)
   WHEN kind = 4 THEN CAST(q AS VARCHAR) ELSE concat('x', q) END AS answer FROM li""")
def nrm6(spark, folder):
    say = spoken(F.lit(20) + F.col("q") % 40)
    df = texts(spark, folder, {1: [say], 2: ["about ", say], 3: [say, " thousand three hundred and five"],
                               4: ["00", q()]}, ["x", q()])
    return df.select("idx", "kind", "part", N.words_to_number(F.col("text")).alias("answer"))


@query("nrm7_clean_units", S + """ SELECT idx, kind, part, CASE kind WHEN 1 THEN concat(q, '/100')
   WHEN 2 THEN concat(q, '*3.14') WHEN 3 THEN concat('3.14+', q) WHEN 4 THEN CAST(q AS VARCHAR)
   ELSE concat(q, '5') END AS answer FROM li""")
def nrm7(spark, folder):
    df = texts(spark, folder, {1: [q(), "%"], 2: [q(), "\\pi"], 3: ["π+", q()], 4: ["$", q(), "°C"]},
               ["¥", q(), "5°"])
    return df.select("idx", "kind", "part", N.clean_units(F.col("text")).alias("answer"))


@query("nrm8_percent_text", S + """ SELECT idx, kind, part, concat('from ', CASE WHEN kind <= 3
   THEN CAST(CAST(q AS DOUBLE) / 100 AS VARCHAR) ELSE CAST((q + 0.5::DOUBLE) / 100 AS VARCHAR) END, ' to ', q, ' kg') AS answer FROM li""")
def nrm8(spark, folder):
    share = F.concat(q(), F.when(F.col("kind") <= 3, "%").otherwise(".5%"))
    text = F.concat(F.lit("from "), share, F.lit(" to "), q(), F.lit(" kg"))
    return lines(spark, folder).select("idx", "kind", "part", U.percent_text_to_decimal(text).alias("answer"))


@query("nrm9_clean_expression", S + r""" SELECT idx, kind, part, CASE kind
   WHEN 1 THEN concat(q, '^{', supp, '}') WHEN 2 THEN concat(q, chr(92), 'times ', supp)
   WHEN 3 THEN concat('x', chr(92), 'geq', q) WHEN 4 THEN concat(chr(92), 'frac{', q % 10, '}{', supp, '}')
   WHEN 5 THEN concat(chr(92), chr(92), 'sqrt{', q, '}') ELSE concat(q, '.5') END AS answer FROM li""")
def nrm9(spark, folder):
    df = texts(spark, folder, {1: [q(), "**(", q("supp"), ")"], 2: [q(), "*", q("supp")],
                               3: ["x\\geq", q()], 4: ["\\dfrac", (F.col("q") % 10).cast("string"), "{", q("supp"), "}"],
                               5: ["\\sqrt(", q(), ")"]}, ["\\left$", q(), " . 5\\right."])
    return df.select("idx", "kind", "part", N.clean_expression(F.col("text")).alias("answer"))


@query("nrm10_truncate", """SELECT doc_id, CASE WHEN length(text) > 400
   THEN concat(substr(text, 1, 200), '...', substr(text, length(text) - 199, 200)) ELSE text END AS short FROM documents""")
def nrm10(spark, folder):
    return table(spark, folder, "documents").select("doc_id", N.truncate_middle(F.col("text")).alias("short"))


@query("nrm11_predicates", r"""SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit,
 NOT regexp_matches(lower(text), 'error|exception|no algorithms|cannot|nan|\.\.\.') AS ran,
 regexp_matches(coalesce(regexp_extract_all(text, '[^ ]+')[1], ''), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') AS first_is_number
 FROM documents""")
def nrm11(spark, folder):
    text = F.col("text")
    first = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0)), F.lit(1)), F.lit(""))
    return table(spark, folder, "documents").select("doc_id", "text").select(
        "doc_id", U.contains_digit(text).alias("has_digit"), N.ran_successfully(text).alias("ran"),
        U.is_number(first).alias("first_is_number"),
    )


# ---------------------------------------------------------------- trajectories
def program_text():
    """Rationale, a program with its output, closing words; every third run fails."""
    fails = F.col("part") % 3 == 0
    out = F.when(fails, F.concat(F.lit("Error: "), q())).otherwise(q())
    return F.concat(
        F.lit("Think "), q(), F.lit("\n```python\nimport math\nx = "), q(), F.lit("\nprint(x)\n```\n```output\n"),
        out, F.lit("\n```\nthen\n```python\ny = "), q("supp"), F.lit("\nprint(y)\n```\n```output\n"), q("supp"),
        F.lit("\n```\nDone "), q(),
    )


@query("trj1_blocks", S + r""" SELECT idx, kind, part, supp, q, b.pos, b.role, b.content FROM (
 SELECT *, unnest([
   {'pos': 0, 'role': 'rationale', 'content': concat('Think ', q, chr(10))},
   {'pos': 1, 'role': 'program', 'content': concat('import math', chr(10), 'x = ', q, chr(10), 'print(x)', chr(10))},
   {'pos': 2, 'role': 'output', 'content': concat(CASE WHEN part % 3 = 0 THEN 'Error: ' ELSE '' END, q, chr(10))},
   {'pos': 3, 'role': 'rationale', 'content': concat('then', chr(10))},
   {'pos': 4, 'role': 'program', 'content': concat('y = ', supp, chr(10), 'print(y)', chr(10))},
   {'pos': 5, 'role': 'output', 'content': concat(supp, chr(10))},
   {'pos': 6, 'role': 'rationale', 'content': concat('Done ', q)}]) AS b FROM li)""")
def trj1(spark, folder):
    df = lines(spark, folder).withColumn("t", T.trajectory(program_text()))
    # Before a plain explode Spark puts a filter on the array, which would cut every text twice.
    blocks = df.select("idx", "kind", "part", "supp", "q", F.posexplode_outer("t").alias("pos", "b")).filter("pos IS NOT NULL")
    return blocks.select("idx", "kind", "part", "supp", "q", "pos", "b.role", "b.content")


@query("trj2_round_trip", S + " SELECT idx, kind, part, supp, true AS same FROM li")
def trj2(spark, folder):
    df = lines(spark, folder).withColumn("text", program_text())
    back = T.trajectory_text(T.trajectory(F.col("text")))
    return df.select("idx", "kind", "part", "supp", (back == F.col("text")).alias("same"))


@query("trj3_merge_programs", S + r""" SELECT idx, kind, part, supp, q, CASE WHEN part % 3 = 0
   THEN concat('import math', chr(10), 'y = ', supp, chr(10), 'print(y)', chr(10))
   ELSE concat('import math', chr(10), 'x = ', q, chr(10), chr(10), 'y = ', supp, chr(10), 'print(y)', chr(10))
   END AS program FROM li""")
def trj3(spark, folder):
    df = lines(spark, folder).withColumn("text", program_text())
    return df.select("idx", "kind", "part", "supp", "q", T.programs(F.col("text")).alias("program"))


@query("trj4_output_blocks", S + """ SELECT idx, kind, part, supp, q, CAST(supp AS VARCHAR) AS last_output, CAST(2 AS INTEGER) AS outputs FROM li""")
def trj4(spark, folder):
    df = lines(spark, folder).withColumn("text", program_text())
    return df.select(
        "idx", "kind", "part", "supp", "q", X.last_output_block(F.col("text")).alias("last_output"),
        F.size(X.output_blocks(F.col("text"))).alias("outputs"),
    )


# ---------------------------------------------------------------- grading rungs
def pairs(spark, folder, branches, otherwise):
    """``branches``: kind -> (prediction parts, gold parts)."""
    return lines(spark, folder).withColumn(
        "pred", by_kind({k: p for k, (p, _) in branches.items()}, otherwise[0])
    ).withColumn("gt", by_kind({k: g for k, (_, g) in branches.items()}, otherwise[1]))


def rungs(df, **options):
    return G.grade(df, **options).select("idx", "kind", "part", "supp", "q", "rung", "score")


def _expect(case: str) -> str:
    return S + f""", x AS (SELECT *, {case} AS rung FROM li)
 SELECT idx, kind, part, supp, q, rung,
        rung IN ('text', 'choice', 'number', 'brackets', 'tuple', 'matrix', 'one_sided', 'value') AS score FROM x"""


@query("grd0_null_and_text", _expect("""CASE WHEN kind <= 2 THEN 'null' WHEN kind <= 4 THEN 'text'
   WHEN kind = 5 THEN 'empty' ELSE 'none' END"""))
def grd0(spark, folder):
    df = pairs(spark, folder, {3: ([" Ab", q(), " "], ["aB", q()]), 4: (["x+", q()], ["X+", q()]),
                               5: ([""], ["ab"])}, (["u", q()], ["w", q()]))
    df = df.withColumn("pred", F.when(F.col("kind") != 1, F.col("pred"))).withColumn(
        "gt", F.when(F.col("kind") != 2, F.col("gt")))
    return rungs(df)


@query("grd2_choice", _expect(f"""CASE WHEN kind <= 3 THEN 'choice'
   WHEN {LETTER} = {OTHER} THEN 'choice' ELSE 'none' END"""))
def grd2(spark, folder):
    a, b = letter(), letter("supp")
    df = pairs(spark, folder, {1: (["(", a, ")"], [a]), 2: (["it is ", a, "."], [a]),
                               3: ([b, " or ", a, "./"], [a])}, (["maybe ", b], [a]))
    return rungs(df)


@query("grd3_numeric", _expect("""CASE WHEN kind <= 4 THEN 'number' WHEN kind = 5 THEN 'number'
   ELSE 'number_differs' END"""))
def grd3(spark, folder):
    df = pairs(spark, folder, {
        1: ([q(), ",000"], [q(), "000"]), 2: ([q(), "%"], [q()]), 3: ([q(), "\\%"], [q(), ".0"]),
        4: ([q(), "00"], [q()]), 5: ([q(), ".00001"], [q()]),
    }, (["1", q()], ["2", q()]))
    return rungs(df)


@query("grd4_parse_digits", S + """ SELECT idx, kind, part, CASE kind WHEN 1 THEN CAST(q * 1000 AS DOUBLE)
   WHEN 2 THEN CAST(q AS DOUBLE) / 100 WHEN 3 THEN CAST(q AS DOUBLE) / 100 WHEN 4 THEN NULL WHEN 5 THEN CAST(q AS DOUBLE) * 10
   ELSE CAST(-q AS DOUBLE) END AS number FROM li""")
def grd4(spark, folder):
    df = texts(spark, folder, {1: [q(), ",000"], 2: [q(), "%"], 3: [q(), "\\%"], 4: [q(), "d"], 5: [q(), "e1"]},
               [" -", q(), ". "])
    return df.select("idx", "kind", "part", U.parse_digits(F.col("text")).alias("number"))


@query("grd5_brackets", _expect("""CASE WHEN kind <= 3 THEN 'brackets' WHEN kind = 4 THEN 'tuple' ELSE 'none' END"""))
def grd5(spark, folder):
    df = pairs(spark, folder, {1: (["[x", q(), "]"], ["x", q()]), 2: (["(X", q(), ")"], ["{x", q(), "}"]),
                               3: (["x_{", q(), "}"], ["x_", q()]), 4: (["[x", q(), "]"], ["(x", q(), ")"])},
               (["[x", q(), "]"], ["y", q()]))
    return rungs(df)


@query("grd6_tuples", _expect("""CASE WHEN kind <= 3 THEN 'tuple' WHEN kind IN (5, 6) THEN 'tuple' ELSE 'none' END"""))
def grd6(spark, folder):
    df = pairs(spark, folder, {
        1: (["(", q(), ".0,", q("supp"), ")"], ["(", q(), ",", q("supp"), ".00)"]),
        2: (["[", q(), ",50%)"], ["[", q(), ",0.5)"]),
        3: (["(\\frac{", q(), "}{2},y)"], ["(", q(), "/2,Y)"]),
        4: (["(", q(), ",1,2)"], ["(", q(), ",1)"]),
        # Elements are graded by all rules again: brackets around one element, equations in a tuple.
        5: (["((", q(), ".0),[(", q("supp"), ")])"], ["((", q(), "),[(", q("supp"), ".0)])"]),
        6: (["(x=", q(), ".0,y = ", q("supp"), ")"], ["(", q(), ",", q("supp"), ".0)"]),
    }, (["(", q(), ",a)"], ["(", q(), ",b)"]))
    return rungs(df)


@query("grd7_closed_forms", _expect("""CASE WHEN kind <= 4 THEN 'value' ELSE 'none' END"""))
def grd7(spark, folder):
    df = pairs(spark, folder, {
        1: (["\\frac{", q(), "}{4}"], ["", q(), "/4"]), 2: (["-\\frac{", q(), "}{2}"], ["-", q(), "/2"]),
        3: ([q(), "/", q()], ["1"]), 4: (["\\frac{", q(), "}{1}"], [q(), ".0"]),
    }, (["\\frac{", q(), "}{3}"], ["\\frac{", q(), "}{7}"]))
    return rungs(df)


def _matrix(*cells):
    return ["\\begin{pmatrix}", *cells, "\\end{pmatrix}"]


@query("grd8_matrices", _expect("""CASE WHEN kind <= 2 OR kind IN (4, 5) THEN 'matrix' ELSE 'none' END"""))
def grd8(spark, folder):
    df = pairs(spark, folder, {
        1: (_matrix(q(), "&1.0\\\\3&4"), _matrix(q(), ".0&1\\\\3&4")),
        2: (_matrix(q(), "&\\frac{1}{2}\\\\"), _matrix(q(), "&0.5")),
        3: (_matrix(q(), "&1\\\\2&3"), _matrix(q(), "&1")),
        # Cells are graded by all rules again: intervals, equations.
        4: (_matrix("(", q(), ",1.0]&[0,", q("supp"), ")\\\\2&3"), _matrix("(", q(), ".0,1]&[0,", q("supp"), ".0)\\\\2&3")),
        5: (_matrix("x=(", q(), ",1.0)&2"), _matrix("(", q(), ".0,1)&y=2.0")),
    }, (_matrix(q(), "&a"), _matrix(q(), "&b")))
    return rungs(df)


@query("grd9_set_as_matrix", _expect("""CASE WHEN kind <= 3 THEN 'brackets' ELSE 'none' END"""))
def grd9(spark, folder):
    # A set is written with single backslashes; a real column matrix is another thing.
    exact = (_matrix(q(), "\\", q("supp")), ["{", q(), ",", q("supp"), "}"])
    df = pairs(spark, folder, {1: exact, 2: exact, 3: exact},
               (_matrix(q(), "\\\\", q("supp")), ["{", q(), ",", q("supp"), "}"]))
    return rungs(df)


@query("grd10_one_sided", _expect("""CASE WHEN kind <= 5 THEN 'one_sided' ELSE 'none' END"""))
def grd10(spark, folder):
    df = pairs(spark, folder, {
        1: (["x=", q()], [q(), ".0"]), 2: ([q()], ["k =", q()]), 3: (["y = \\frac{", q(), "}{2}"], [q(), "/2"]),
        4: (["x=(", q(), ",2.0)"], ["(", q(), ".0,2)"]), 5: (["k=", *_matrix(q(), ".0\\\\2")], _matrix(q(), "\\\\2")),
    }, (["area=", q()], [q()]))
    return rungs(df)


@query("grd12_absolute", S + """ SELECT idx, kind, part, kind <= 4 AS same FROM li""")
def grd12(spark, folder):
    df = pairs(spark, folder, {
        1: (["$", q(), ",000"], [q(), "000"]), 2: ([q(), "%"], ["0", ".0"][:1]), 3: ([q(), ".0005"], [q()]),
        4: ([q()], ["$", q(), ".0"]), 5: ([q(), ".002"], [q()]),
    }, (["abc"], [q()]))
    df = df.withColumn("gt", F.when(F.col("kind") == 2, U.python_float_text(F.col("q") / 100)).otherwise(F.col("gt")))
    return df.select("idx", "kind", "part", G.close_by_absolute(F.col("pred"), F.col("gt")).alias("same"))


@query("grd13_rough", S + """ SELECT idx, kind, part, kind <= 3 AS same FROM li""")
def grd13(spark, folder):
    df = pairs(spark, folder, {
        1: (["first 999\nwe get ", q(), " at last"], [q()]), 2: (["so $", q(), "$ then\nno digits"], [q()]),
        3: (["it is ", q(), ".0001 now"], [q()]), 4: (["add 3 + ", q(), " ok"], [q()]),
    }, (["we have ", q(), "1"], [q()]))
    return df.select("idx", "kind", "part", G.rough_match(F.col("pred"), F.col("gt")).alias("same"))


@query("grd14_after_cleaning", S + """ SELECT idx, kind, part, kind <= 4 AS same FROM li""")
def grd14(spark, folder):
    df = pairs(spark, folder, {
        1: (["\\$", q(), " x"], [q(), "x"]), 2: (["\\dfrac{", q(), "}{2}"], ["\\frac{", q(), "}{2}"]),
        3: (["we get ", q(), " kg"], [q()]), 4: ([q(), ",000"], [q(), "000"]),
    }, (["value ", q(), "1"], [q()]))
    return df.select("idx", "kind", "part", G.same_after_cleaning(F.col("pred"), F.col("gt")).alias("same"))
