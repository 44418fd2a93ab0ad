"""Question adapters, prompts, projections and filters over composed question tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards
from ..functions import fixed_values as V
from ..functions.normalize import normalize_relations
from ..operators import adapters as A
from ..operators import chats as T
from ..operators import ordering as O
from ..operators import prompts as P
from .fixtures import RUNS, parsed_runs
from .registry import query, table


def parts(spark, folder):
    return table(spark, folder, "part")


def c(name):
    return F.col(name).cast("string")


KEY = "p_partkey"


# ---------------------------------------------------------------- gold answers
@query("adp1_existing_gold", r"""SELECT p_partkey, p_name AS gt_cot, concat(chr(92), 'frac{', p_size, '}{7}') AS gt,
  concat(p_size, '/7 ') AS untouched FROM part""")
def adp1(spark, folder):
    df = parts(spark, folder).select(
        KEY, F.col("p_name").alias("gt_cot"), F.concat(c("p_size"), F.lit("/7 ")).alias("gt")
    )
    done = A.with_ground_truth(df, "gsm8k")
    raw = A.with_ground_truth(df, "carp_en").select(KEY, F.col("gt").alias("untouched"))
    return done.join(raw, KEY)


@query("adp2_worked_solution", r"""SELECT p_partkey, concat(p_name, ' gives ', chr(92), 'boxed{', p_size, '}.') AS gt_cot,
  CAST(p_size AS VARCHAR) AS gt FROM part""")
def adp2(spark, folder):
    df = parts(spark, folder).withColumn(
        "solution", F.concat(F.lit(" "), "p_name", F.lit(" gives \\boxed{"), c("p_size"), F.lit("}. "))
    )
    return A.with_ground_truth(df, "math500").select(KEY, "gt_cot", "gt")


@query("adp3_rationale_split", """SELECT p_partkey, p_name AS gt_cot, concat(p_size, ',000') AS gt FROM part""")
def adp3(spark, folder):
    df = parts(spark, folder).withColumn("answer", F.concat("p_name", F.lit("\n#### "), c("p_size"), F.lit(",000")))
    return A.with_ground_truth(df, "gsm8k").select(KEY, "gt_cot", "gt")


@query("adp4_field_picks", """SELECT p_partkey, 'svamp' AS dataset, p_type AS gt_cot, CAST(p_size AS VARCHAR) AS gt FROM part
 UNION ALL SELECT p_partkey, 'mawps', 'None', CAST(p_size AS VARCHAR) FROM part
 UNION ALL SELECT p_partkey, 'carp_en', p_type, concat(p_size, '.0') FROM part
 UNION ALL SELECT p_partkey, 'aqua', 'None', substr('ABCDE', p_size % 5 + 1, 1) FROM part
 UNION ALL SELECT p_partkey, 'gaokao_math_qa', 'None', substr('ABCDE', p_size % 5 + 1, 1) FROM part""")
def adp4(spark, folder):
    pick = F.substr(F.lit("ABCDE"), F.col("p_size") % 5 + 1, F.lit(1))
    df = parts(spark, folder).select(
        KEY, F.col("p_type").alias("Equation"), F.col("p_size").cast("double").alias("Answer"),
        F.col("p_size").cast("double").alias("target"), F.col("p_type").alias("steps"),
        F.concat(c("p_size"), F.lit(".0")).alias("answer_text"), pick.alias("correct"), pick.alias("label"),
    )
    frames = []
    for name in ("svamp", "mawps", "carp_en", "aqua", "gaokao_math_qa"):
        one = df.drop("Answer").withColumnRenamed("answer_text", "answer") if name == "carp_en" else df
        frames.append(A.with_ground_truth(one, name).select(KEY, F.lit(name).alias("dataset"), "gt_cot", "gt"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("adp5_parentheses", """SELECT p_partkey, p_type AS gt_cot, CAST(p_size AS VARCHAR) AS gt FROM part""")
def adp5(spark, folder):
    df = parts(spark, folder).select(
        KEY, F.col("p_type").alias("formula"), F.concat(c("p_size"), F.lit(" (apples) (total)")).alias("answer")
    )
    return A.with_ground_truth(df, "asdiv").select(KEY, "gt_cot", "gt")


@query("adp6_typed_numbers", r"""SELECT p_partkey, CASE p_partkey % 5
   WHEN 0 THEN regexp_replace(CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR), '\.0$', '')
   WHEN 1 THEN concat(p_size, '000')
   WHEN 2 THEN CAST(CAST(p_size AS DOUBLE) / 100 AS VARCHAR)
   WHEN 3 THEN concat(p_size, '.5') ELSE concat(p_size, ' ', p_name) END AS answer FROM part""")
def adp6(spark, folder):
    size, kind = c("p_size"), F.col(KEY) % 5
    answer = (
        F.when(kind == 0, F.concat(size, F.lit("/4"))).when(kind == 1, F.concat(size, F.lit(",000")))
        .when(kind == 2, F.concat(size, F.lit("%"))).when(kind == 3, F.concat(size, F.lit(".5")))
        .otherwise(F.concat(size, F.lit(" "), "p_name"))
    )
    typed = A.typed_number(F.col("a"), F.when(kind == 4, "extractive_text").otherwise("decimal_number"))
    return parts(spark, folder).withColumn("a", answer).select(
        KEY, F.regexp_replace(typed, r"\.0$", "").alias("answer")
    )


@query("adp7_choice_index", "SELECT p_partkey, 'None' AS gt_cot, substr('ABCD', CAST(p_partkey % 4 AS INTEGER) + 1, 1) AS gt FROM part")
def adp7(spark, folder):
    df = parts(spark, folder).select(KEY, (F.col(KEY) % 4).alias("answer"))
    return A.with_ground_truth(df, "mmlu_stem").select(KEY, "gt_cot", "gt")


@query("adp8_choice_or_answer", """SELECT p_partkey, CASE WHEN p_size % 2 = 0
   THEN substr('ABCD', p_size % 4 + 1, 1) ELSE CAST(p_size AS VARCHAR) END AS gt FROM part""")
def adp8(spark, folder):
    letter = F.substr(F.lit("ABCD"), F.col("p_size") % 4 + 1, F.lit(1))
    df = parts(spark, folder).select(
        KEY, c("p_size").alias("answer"), F.when(F.col("p_size") % 2 == 0, letter).otherwise("").alias("choice_answer")
    )
    return A.with_ground_truth(df, "cn_middle_school").select(KEY, "gt")


@query("adp9_dollar_strip", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS first_gt,
  concat(p_size, '+x') AS plain_gt FROM part""")
def adp9(spark, folder):
    size = c("p_size")
    listed = parts(spark, folder).select(
        KEY, F.array(F.concat(F.lit("$"), size, F.lit("$")), F.lit("other")).alias("final_answer")
    )
    dollars = parts(spark, folder).select(KEY, F.concat(F.lit(" $"), size, F.lit("$+x ")).alias("answer"))
    first = A.with_ground_truth(listed, "olympiadbench").select(KEY, F.col("gt").alias("first_gt"))
    plain = A.with_ground_truth(dollars, "college_math").select(KEY, F.col("gt").alias("plain_gt"))
    return first.join(plain, KEY)


@query("adp10_relations", r"""SELECT p_partkey, concat('x', chr(92), 'le', p_size, chr(92), 'ne', ' 3 ', chr(92), 'ge') AS gt FROM part""")
def adp10(spark, folder):
    text = F.concat(F.lit("x\\leq"), c("p_size"), F.lit("\\neq 3 \\geq"))
    return parts(spark, folder).select(KEY, normalize_relations(text).alias("gt"))


# ---------------------------------------------------------------- questions
@query("qst1_body_question", """SELECT p_partkey, concat(p_name, '. How many ', p_type, '?') AS question FROM part""")
def qst1(spark, folder):
    stop = F.when(F.col("p_size") % 2 == 0, ". ").otherwise(" ")
    body, asked = F.concat(F.col("p_name"), stop), F.concat(F.lit(" How many "), "p_type", F.lit("? "))
    return parts(spark, folder).select(KEY, A.body_and_question(body, asked, full_stop=True).alias("question"))


@query("qst2_table_question", r"""SELECT p_partkey, concat('Read the following table ',
   CASE WHEN p_size % 2 = 0 THEN concat('regarding "', p_type, '" ') ELSE '' END, 'and answer a question:', chr(10),
   'a | ', p_size, chr(10), p_name, '?',
   CASE WHEN p_size % 3 = 0 THEN concat(' Please select from the following options: [''', p_name, ''', "it''s"]') ELSE '' END) AS question FROM part""")
def qst2(spark, folder):
    title = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    choices = F.when(F.col("p_size") % 3 == 0, F.array(F.col("p_name"), F.lit("it's")))
    body = F.concat(F.lit("a | "), c("p_size"))
    return parts(spark, folder).select(
        KEY, A.table_question(title, body, F.concat("p_name", F.lit("?")), choices).alias("question")
    )


def _choices():
    return F.array(F.concat(F.lit(" "), "p_name"), F.col("p_type"), c("p_size"), F.col("p_brand"))


@query("qst3_lettered_options", """SELECT p_partkey, concat(p_name, '?', chr(10), 'Answer Choices: (A) ', p_name, ' (B) ', p_type,
   ' (C) ', p_size, ' (D) ', p_brand) AS question FROM part""")
def qst3(spark, folder):
    df = parts(spark, folder).select(
        KEY, F.concat("p_name", F.lit("? ")).alias("question"), _choices().alias("choices"), (F.col("p_size") % 4).alias("answer")
    )
    return A.with_question(df, "mmlu_stem").select(KEY, "question")


@query("qst4_inline_options", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('(A) ', p_name, ' (B) (C) (D) ', p_brand)
   ELSE concat('(A) ', p_name, ' (B) ', p_type, ' (C) ', p_size, ' (D) ', p_brand) END AS options FROM part""")
def qst4(spark, folder):
    # In a third of the rows labels follow each other directly.
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("A) "), "p_name", F.lit(" B) C) D) "), "p_brand")).otherwise(
        F.concat(F.lit("A) "), "p_name", F.lit(" B) "), "p_type", F.lit(" C) "), c("p_size"), F.lit(" D) "), "p_brand")
    )
    return parts(spark, folder).select(KEY, A.inline_options(raw).alias("options"))


@query("qst5_joined_options", """SELECT p_partkey, concat('(A) ', p_name, ' (B) ', p_type, ' (C) ', p_size) AS options FROM part""")
def qst5(spark, folder):
    listed = F.array(F.concat(F.lit("A)"), "p_name"), F.concat(F.lit("B)"), "p_type"), F.concat(F.lit("C)"), c("p_size")))
    return parts(spark, folder).select(KEY, A.joined_options(listed).alias("options"))


@query("qst6_keyed_options", """SELECT p_partkey, concat('(A) ', p_name, ' (B) ', p_type, ' (C) ', p_size) AS options FROM part""")
def qst6(spark, folder):
    keyed = F.create_map(F.lit("C"), c("p_size"), F.lit("A"), F.col("p_name"), F.lit("B"), F.col("p_type"))
    return parts(spark, folder).select(KEY, A.keyed_options(keyed).alias("options"))


@query("qst7_first_present", "SELECT p_partkey, p_name AS question FROM part")
def qst7(spark, folder):
    df = parts(spark, folder).select(KEY, F.col("p_name").alias("problem"), F.col("p_type").alias("input"))
    return df.select(KEY, A.first_present(df).alias("question"))


@query("qst8_answer_kind", """SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' (True or False)'
   WHEN 1 THEN ' (Yes or No)' ELSE '' END) AS question FROM part""")
def qst8(spark, folder):
    kind = F.col("p_size") % 4
    gt = F.when(kind == 0, "True").when(kind == 1, "no").when(kind == 2, "trues").otherwise("7")
    df = parts(spark, folder).select(KEY, F.concat(F.lit(" "), "p_name").alias("question"), gt.alias("gt"))
    return A.with_question(df, "amc23").select(KEY, "question")


# ---------------------------------------------------------------- prompts
def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TEMPLATE_ROWS = ",\n".join(
    f"({i}, {_text(n)}, {_text(t[0])}, {_text(t[1])}, {_text(t[2])})"
    for i, (n, t) in enumerate(V.PROMPT_TEMPLATES.items())
)
TEMPLATES = f"templates(n, prompt_type, input, output, splitter) AS (VALUES {TEMPLATE_ROWS})"
FILLED = "replace(replace(replace(input, '{input}', %s), '{{', '{'), '}}', '}')"


@query("pmt1_templates", f"""WITH {TEMPLATES}
 SELECT p_partkey, prompt_type, {FILLED % "p_name"} AS prompt FROM part JOIN templates ON n = p_partkey % 27""")
def pmt1(spark, folder):
    names = F.array(*[F.lit(n) for n in V.PROMPT_TEMPLATES])
    df = parts(spark, folder).withColumn("prompt_type", F.get(names, (F.col(KEY) % 27).cast("int")))
    joined = df.join(F.broadcast(P.templates(spark)), "prompt_type")
    return joined.select(KEY, "prompt_type", P.fill(F.col("input"), "input", F.col("p_name")).alias("prompt"))


DATASETS = ["gsm8k", "svamp", "amc23", "sat_math", "gaokao2024_mix", "minerva_math", "tabmwp"]
FAMILIES = ["gsm8k", "math", "mmlu_stem", "gaokao", "minerva_math"]
QUESTIONS = f"""qs AS (SELECT *, CASE dataset WHEN 'svamp' THEN 'gsm8k' WHEN 'tabmwp' THEN 'gsm8k' WHEN 'amc23' THEN 'math'
    WHEN 'sat_math' THEN 'mmlu_stem' WHEN 'gaokao2024_mix' THEN 'gaokao' ELSE dataset END AS family
  FROM (SELECT p_partkey, {DATASETS}[p_partkey % 7 + 1] AS dataset, p_name AS question,
               CASE WHEN p_size % 2 = 0 THEN substr('ABCDE', p_size % 5 + 1, 1) ELSE CAST(p_size AS VARCHAR) END AS gt FROM part)),
 bank AS (SELECT {FAMILIES}[n_regionkey + 1] AS family, n_nationkey // 5 AS pos,
                 concat('Where is ', n_name, '?') AS q, concat('Region ', n_regionkey) AS a FROM nation)"""


def question_table(spark, folder):
    letter = F.substr(F.lit("ABCDE"), F.col("p_size") % 5 + 1, F.lit(1))
    return parts(spark, folder).select(
        KEY, F.get(F.array(*[F.lit(d) for d in DATASETS]), (F.col(KEY) % 7).cast("int")).alias("dataset"),
        F.col("p_name").alias("question"),
        F.when(F.col("p_size") % 2 == 0, letter).otherwise(c("p_size")).alias("gt"),
    )


def demo_bank(spark, folder):
    return table(spark, folder, "nation").select(
        F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("n_regionkey")).alias("family"),
        F.floor(F.col("n_nationkey") / 5).cast("int").alias("pos"),
        F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"),
        F.concat(F.lit("Region "), c("n_regionkey")).alias("answer"),
    )


@query("pmt2_demo_lookup", f"""WITH {QUESTIONS}
 SELECT p_partkey, dataset, qs.family, CAST(count(*) AS INTEGER) AS shots, string_agg(q, '|' ORDER BY pos) AS asked
 FROM qs JOIN bank ON bank.family = qs.family AND pos < 3 GROUP BY ALL""")
def pmt2(spark, folder):
    lists = P.demo_lists(demo_bank(spark, folder), 3)
    df = question_table(spark, folder).withColumn("family", P.demo_family(F.col("dataset"))).join(lists, "family")
    return df.select(
        KEY, "dataset", "family", F.size("demos").alias("shots"), F.array_join("demos.question", "|").alias("asked")
    )


@query("pmt3_few_shot", f"""WITH {QUESTIONS},
 d AS (SELECT bank.family, string_agg(concat('Question: ', q, chr(10), 'Answer: ', a), repeat(chr(10), 3) ORDER BY pos) AS cot,
              string_agg(concat(q, chr(10), a), repeat(chr(10), 2) ORDER BY pos) AS single FROM bank WHERE pos < 2 GROUP BY 1)
 SELECT p_partkey, trim(concat(cot, repeat(chr(10), 3), 'Question: ', question, chr(10), 'Answer: '), ' ') AS cot_prompt,
   concat('<|im_start|>system', chr(10), 'Please reason step by step, and put your final answer within ', chr(92), 'boxed{{}}.<|im_end|>',
          chr(10), '<|im_start|>user', chr(10), single, repeat(chr(10), 2), question, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS single_prompt
 FROM qs JOIN d USING (family)""".replace("{{}}", "{}"))
def pmt3(spark, folder):
    df, bank = question_table(spark, folder), demo_bank(spark, folder)
    cot = P.build_prompts(df, "cot", bank, 2).withColumnRenamed("prompt", "cot_prompt")
    both = P.build_prompts(cot, "qwen25-math-cot", bank, 2)
    return both.select(KEY, "cot_prompt", F.col("prompt").alias("single_prompt"))


@query("pmt4_conditional_shots", f"""WITH {QUESTIONS},
 d AS (SELECT bank.family, string_agg(concat('Question: ', q, chr(10), 'Answer: ', a), repeat(chr(10), 2) ORDER BY pos) FILTER (pos < 1) AS one,
              string_agg(concat('Question: ', q, chr(10), 'Answer: ', a), repeat(chr(10), 2) ORDER BY pos) AS five FROM bank GROUP BY 1)
 SELECT p_partkey, dataset, trim(concat(CASE WHEN gt IN ('A', 'B', 'C', 'D', 'E')
     THEN concat(CASE WHEN dataset = 'gaokao2024_mix' THEN five ELSE one END, repeat(chr(10), 2)) ELSE '' END,
   'Question: ', question, chr(10), 'Answer: '), ' ') AS prompt FROM qs JOIN d USING (family)""")
def pmt4(spark, folder):
    df = P.build_prompts(question_table(spark, folder), "direct", demo_bank(spark, folder), 1, adapt_few_shot=True)
    return df.select(KEY, "dataset", "prompt")


THINK = "'<think>', repeat(chr(10), 2), '</think>', repeat(chr(10), 2)"


@query("pmt5_wrappers", f"""WITH {QUESTIONS}
 SELECT p_partkey, concat({_text(V.INSTRUCTION_WRAPPER[0])}, '### Instruction:', chr(10), question, repeat(chr(10), 2), '### Response:', chr(10),
          {_text(V.INSTRUCTION_WRAPPER[1])}) AS wrapped,
   concat({_text(V.CODE_GUIDELINES)}, '<|user|>', chr(10), question, chr(10), '<|assistant|>', chr(10)) AS coded,
   concat('Question:', question, chr(10), 'Answer:', {THINK}) AS unthinking,
   concat('Question:', question, chr(10), 'Answer:', {THINK}) AS no_budget FROM qs""")
def pmt5(spark, folder):
    df = question_table(spark, folder)
    for name, prompt_type, options in (
        ("wrapped", "platypus_fs", {}), ("coded", "tora", {}),
        ("unthinking", "internlm-math-fs", {"model": "Org/Qwen3-30B", "enable_thinking": False}),
        ("no_budget", "internlm-math-fs", {"thinking_budget": 0}),
    ):
        df = P.build_prompts(df, prompt_type, **options).withColumnRenamed("prompt", name)
    return df.select(KEY, "wrapped", "coded", "unthinking", "no_budget")


@query("pmt6_fan_out", """SELECT o_orderkey AS idx, CAST(s AS INTEGER) AS sample_id, o_orderpriority AS prompt
 FROM (SELECT *, unnest(range(4)) AS s FROM orders)""")
def pmt6(spark, folder):
    prompts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("prompt")
    )
    return P.fan_out(prompts, 4)


STOP_TYPES = ["cot", "pal", "wizard_zs", "jiuzhang_nl", "numina", "pure", "direct"]
STOP_ROWS = ",\n".join(f"({_text(t)}, {i}, {_text(w)})" for t, i, w in [
    (t, i, w) for t, extra in (
        ("cot", ["\n\nQuestion:"]), ("pal", ["\n\n---", "```output"]), ("wizard_zs", ["Instruction", "Response"]),
        ("jiuzhang_nl", ["\n\n## Question"]), ("numina", ["\n### Problem"]), ("pure", ["\n\n\n"]), ("direct", []),
    ) for i, w in enumerate(["</s>", "<|im_end|>", "<|endoftext|>", *extra])])


@query("pmt7_stop_words", f"""WITH stops(prompt_type, pos, word) AS (VALUES {STOP_ROWS})
 SELECT p_partkey, prompt_type, CAST(pos AS INTEGER) AS pos, word
 FROM (SELECT p_partkey, {STOP_TYPES}[p_partkey % 7 + 1] AS prompt_type FROM part) JOIN stops USING (prompt_type)""")
def pmt7(spark, folder):
    kinds = F.array(*[F.lit(t) for t in STOP_TYPES])
    df = parts(spark, folder).select(KEY, F.get(kinds, (F.col(KEY) % 7).cast("int")).alias("prompt_type"))
    return df.join(F.broadcast(P.stop_words(spark, STOP_TYPES)), "prompt_type")


@query("pmt8_thinking_text", f"""SELECT conv_id, turn, concat('P:', text, CASE WHEN turn % 2 = 0 THEN '</think>'
   ELSE {_text(V.THINKING_CLOSER)} END) AS prompt FROM conversations""")
def pmt8(spark, folder):
    thought = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("</think>"))).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", P.with_thinking(F.lit("P:"), thought).alias("prompt")
    )


SCORED_HEAD = r"""concat('<|im_start|>system', chr(10), 'Please reason step by step, and put your final answer within ', chr(92),
   'boxed{}.<|im_end|>', chr(10), '<|im_start|>user', chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10),
   '<think>', chr(10), chr(10), '</think>', chr(10), chr(10))"""


@query("pmt9_scoring_text", rf"""SELECT conv_id, turn, concat(prompt, CASE WHEN turn % 2 = 0 THEN role ELSE 'solved' END) AS scored_text,
   CAST(len(string_split_regex(regexp_replace(prompt, '\s+$', ''), '\s+')) AS INTEGER) AS prompt_len
 FROM (SELECT *, {SCORED_HEAD} AS prompt FROM conversations)""")
def pmt9(spark, folder):
    df = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("code"), F.lit(" solved ").alias("solution")
    )
    even, odd = df.filter("turn % 2 = 0"), df.filter("turn % 2 = 1")
    both = P.scoring_text(even).unionByName(P.scoring_text(odd, use_solution=True))
    return both.select("conv_id", "turn", "scored_text", "prompt_len")


@query("pmt10_chat_prompt", """SELECT conv_id, turn, concat('<|im_start|>user', chr(10), text, '<|im_end|>', chr(10),
   '<|im_start|>assistant', chr(10)) AS prompt FROM conversations""")
def pmt10(spark, folder):
    template = "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n"
    padded = F.concat(F.lit(" \n"), "text", F.lit("\n"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", P.chat_prompt(padded, template).alias("prompt")
    )


# ---------------------------------------------------------------- joins with small tables
@query("jn4_alias_lookup", f"""WITH {QUESTIONS} SELECT p_partkey, dataset, family FROM qs""")
def jn4(spark, folder):
    df = question_table(spark, folder).join(F.broadcast(P.demo_aliases(spark)), "dataset", "left")
    return df.select(KEY, "dataset", F.coalesce("family", "dataset").alias("family"))


# ---------------------------------------------------------------- projections
@query("prj1_lower_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj1(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return A.lower_columns(df.toDF("C_CustKey", "C_NAME", "c_mktsegment"))


@query("prj2_rename_and_stem_subjects", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'astronomy' ELSE 'machine_learning' END AS type
 FROM part WHERE p_size % 3 < 2""")
def prj2(spark, folder):
    size = F.col("p_size") % 3
    subject = F.when(size == 0, "astronomy").when(size == 1, "machine_learning").otherwise("world_religions")
    return A.keep_stem_subjects(parts(spark, folder).select(KEY, subject.alias("subject")))


@query("prj3_carried_fields", "SELECT doc_id AS idx, text AS question, lang AS level, source AS dataset FROM documents")
def prj3(spark, folder):
    df = table(spark, folder, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("question"), F.col("lang").alias("level"),
        F.col("source").alias("dataset"), F.col("n_chars").alias("not_carried"),
    )
    return A.keep_carried(df)


@query("prj4_add_index", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, quality FROM labels")
def prj4(spark, folder):
    return O.with_index(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


@query("prj4_file_order_index", "SELECT o_orderkey AS idx, o_orderkey, o_custkey FROM orders")
def prj4_file(spark, folder):
    # The order file is written in key order, so the place in the file is the key.
    return O.with_file_index(table(spark, folder, "orders")).select("idx", "o_orderkey", "o_custkey")


@query("prj5_array_unpack", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[64] AS DOUBLE) AS y, CAST(label AS VARCHAR) AS answer FROM embeddings")
def prj5(spark, folder):
    listed = F.array(F.concat(F.lit("$"), c("label"), F.lit("$")))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 64).cast("double").alias("y"), A.first_answer(listed).alias("answer"),
    )


@query("prj6_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview FROM documents")
def prj6(spark, folder):
    return table(spark, folder, "documents").select("doc_id", cards.preview(F.col("text")).alias("preview"))


@query("prj7_sample_card", """SELECT idx, concat('Idx: ', idx, chr(10), 'Type: ', p_type, chr(10), 'Question: ',
   CASE WHEN p_size % 3 = 0 THEN concat('"', p_name, chr(39), 's', chr(92), 'n', chr(92), chr(92), 'x"') ELSE concat(chr(39), p_name, chr(39)) END, chr(10), 'Solution:', chr(10),
   ' ', p_brand, chr(10), 'Execution: ', report, chr(10), 'Prediction: ', chr(39), p_size, chr(39), chr(10), 'Ground Truth: ', chr(39), p_size, chr(39), chr(10),
   'Score: [', CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END, ', True]') AS card
  FROM (SELECT p_partkey AS idx, 'Done' AS report, * FROM part)""")
def prj7(spark, folder):
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("'s\n\\x"))).otherwise(F.col("p_name"))
    df = parts(spark, folder).select(
        F.col(KEY).alias("idx"), F.col("p_type").alias("type"), name.alias("question"),
        F.array("p_brand").alias("code"), F.array(F.lit("Done")).alias("report"), F.array(c("p_size")).alias("pred"),
        c("p_size").alias("gt"), F.array(F.col("p_size") % 2 == 0, F.lit(True)).alias("score"),
    )
    return df.select("idx", cards.sample_card(df).alias("card"))


# ---------------------------------------------------------------- filters
@query("flt1_multi_answers", "SELECT p_partkey, concat(p_name, '|', p_size) AS answer FROM part WHERE p_size % 5 <> 0")
def flt1(spark, folder):
    mark = F.when(F.col("p_size") % 5 == 0, ";").otherwise("|")
    return A.drop_multi_answers(parts(spark, folder).select(KEY, F.concat("p_name", mark, c("p_size")).alias("answer")))


@query("flt2_membership", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7')")
def flt2(spark, folder):
    return A.keep_values(table(spark, folder, "documents"), "source", ["src0", "src3", "src7"]).select("doc_id", "source")


@query("flt3_exclusion", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3', 'src7')")
def flt3(spark, folder):
    return A.drop_values(table(spark, folder, "documents"), "source", ["src0", "src3", "src7"]).select("doc_id", "source")


@query("flt4_empty_questions", "SELECT p_partkey, p_name AS question FROM part WHERE p_size % 4 <> 0")
def flt4(spark, folder):
    text = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name"))
    return P.without_empty_questions(parts(spark, folder).select(KEY, text.alias("question")))


@query("flt5_distinct_domains", "SELECT DISTINCT source, (SELECT count(DISTINCT source) FROM documents) AS domains FROM documents")
def flt5(spark, folder):
    docs = table(spark, folder, "documents")
    total = docs.agg(F.countDistinct("source").alias("domains")).withColumn("_one", F.lit(1))
    named = A.distinct_values(docs, "source").withColumn("_one", F.lit(1))
    return named.join(F.broadcast(total), "_one").drop("_one")


@query("sft6_domain_filter", "SELECT doc_id, text, lang FROM documents WHERE source IN ('src1')")
def sft6(spark, folder):
    return A.keep_values(table(spark, folder, "documents"), "source", ["src1"]).select("doc_id", "text", "lang")


# ---------------------------------------------------------------- row selection and order
@query("smp1_slice", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 900 OFFSET 100")
def smp1(spark, folder):
    return O.take_slice(table(spark, folder, "events").select("event_id", "user_id"), "event_id", head=1000, start=100)


@query("smp2_shuffle", """SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY substr(md5(concat('7|', o_orderkey)), 1, 15), o_orderkey) AS place FROM orders""")
def smp2(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    placed = O.with_index(rows.withColumn("_order", O.shuffle_key("o_orderkey", 7)), "_order", "place")
    return placed.select("o_orderkey", "o_custkey", (F.col("place") + 1).alias("place"))


@query("smp3_cap_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def smp3(spark, folder):
    return O.first_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500)


@query("set1_union_splits", "SELECT conv_id, turn, role FROM conversations")
def set1(spark, folder):
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    named = chats.filter("role = 'user'").unionByName(chats.filter("role = 'assistant'"))
    return named.unionByName(chats.filter("role IS NULL OR role NOT IN ('user', 'assistant')"))


@query("srt1_sort_by_key", "SELECT conv_id, turn, length(text) AS chars FROM conversations ORDER BY conv_id, turn")
def srt1(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars")).orderBy("conv_id", "turn")


# ---------------------------------------------------------------- names
@query("snk4_metrics_sidecar", f"""WITH {RUNS} SELECT run_no, time_seconds,
  printf('%d:%02d', CAST(floor(time_seconds / 60) AS BIGINT), CAST(floor(time_seconds) AS BIGINT) % 60) AS time_minutes FROM runs""")
def snk4(spark, folder):
    return parsed_runs(spark, folder).select(
        "run_no", "time_seconds", cards.minutes_seconds(F.col("time_seconds")).alias("time_minutes")
    )


@query("snk7_slug", "SELECT doc_id, concat(source, '--', lang, CASE WHEN doc_id % 2 = 0 THEN '--main' ELSE '' END) AS slug FROM documents")
def snk7(spark, folder):
    config = F.when(F.col("doc_id") % 2 == 0, "main")
    return table(spark, folder, "documents").select(
        "doc_id", cards.dataset_slug(F.concat("source", F.lit("/"), "lang"), config).alias("slug")
    )


@query("snk9_run_name", f"""WITH {RUNS} SELECT run_no, concat('test_cot_-1_seed0_t0.0_top_k', top_k, '_enable_thinking',
   CASE WHEN is_thinking_mode THEN 'True' ELSE 'False' END, '_n_sampling', top_k, '_s0_e-1.jsonl') AS file_name FROM runs""")
def snk9(spark, folder):
    df = parsed_runs(spark, folder)
    flag = F.when(F.col("is_thinking_mode"), "True").otherwise("False")
    prefix = cards.run_name(
        {"num_test_sample": F.lit(-1), "seed": F.lit(0), "temperature": F.lit("0.0"), "top_k": F.col("top_k"),
         "enable_thinking": flag, "n_sampling": F.col("top_k")}, F.lit("test"), F.lit("cot"))
    return df.select("run_no", cards.out_file_name(prefix, F.lit(0), F.lit(-1)).alias("file_name"))


# ---------------------------------------------------------------- training records
CHAT_TAGS = {"user": "human", "assistant": "gpt", "system": "system"}


def _records(spark, folder):
    return T.chat_records(table(spark, folder, "conversations"), CHAT_TAGS)


@query("sft1_chat_records", """SELECT conv_id, CAST(count(*) AS INTEGER) AS turns,
  string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'system' END, ',' ORDER BY turn) AS tags,
  md5(string_agg(text, '|' ORDER BY turn)) AS digest
 FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id""")
def sft1(spark, folder):
    return _records(spark, folder).select(
        "conv_id", F.size("conversations").alias("turns"), F.array_join("conversations.from", ",").alias("tags"),
        F.md5(F.array_join("conversations.value", "|").cast("binary")).alias("digest"),
    )


@query("sft2_rendered", """SELECT conv_id, md5(concat(CASE WHEN bool_or(role = 'system') THEN '' ELSE concat('<|im_start|>system', chr(10), 'Be brief.<|im_end|>', chr(10)) END,
  string_agg(concat('<|im_start|>', role, chr(10), coalesce(text, ''), '<|im_end|>', chr(10)), '' ORDER BY turn))) AS digest
 FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id""")
def sft2(spark, folder):
    names = {tag: role for role, tag in CHAT_TAGS.items()}
    text = T.rendered(F.col("conversations"), names, "Be brief.")
    return _records(spark, folder).select("conv_id", F.md5(text.cast("binary")).alias("digest"))


@query("sft3_cut_off", """SELECT conv_id, CAST(least(n, 40) AS INTEGER) AS n_tokens, n > 40 AS was_cut, md5(array_to_string(t[1:40], ' ')) AS digest
 FROM (SELECT conv_id, t, len(t) AS n FROM (SELECT conv_id, string_split(string_agg(coalesce(text, ''), ' ' ORDER BY turn), ' ') AS t
   FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id))""")
def sft3(spark, folder):
    words = F.split(F.array_join("conversations.value", " ", ""), " ")
    cut = _records(spark, folder).select("conv_id", T.cut_off(words, 40).alias("c")).select("conv_id", "c.*")
    return cut.select("conv_id", F.size("tokens").alias("n_tokens"), "was_cut", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("sft5_packed", """SELECT conv_id, CAST(n AS INTEGER) AS n_tokens, true AS fits, CAST(sum(n) OVER () AS BIGINT) AS all_tokens
 FROM (SELECT conv_id, len(string_split(string_agg(coalesce(text, ''), ' ' ORDER BY turn), ' ')) AS n
   FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id)""")
def sft5(spark, folder):
    """Every record once, no bin over its budget but with one longer record, and bins filled to more than half."""
    budget = 512
    words = F.split(F.array_join("conversations.value", " ", ""), " ")
    sizes = _records(spark, folder).select("conv_id", F.size(words).alias("n_tokens"))
    bins = T.packed(sizes, "conv_id", "n_tokens", budget, group=8)
    filled = bins.groupBy("bin").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("records"))
    capped = F.sum(F.least("held", F.lit(budget)))
    total = filled.agg(F.sum("held").alias("all_tokens"), capped.alias("within"), F.count("*").alias("bins"))
    one = F.lit(1).alias("_one")
    checked = bins.join(filled, "bin").select("*", one).join(F.broadcast(total.select("*", one)), "_one")
    half = F.col("bins") <= 2 * F.ceil(F.col("within") / budget) + 1
    alone = (F.col("held") <= budget) | (F.col("records") == 1)
    return checked.select("conv_id", "n_tokens", (alone & half).alias("fits"), "all_tokens")
