"""Prompt construction: templates, demos, wrappers, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.pytext import replace_all, strip


def templates(spark: SparkSession) -> DataFrame:
    """The named templates as a table (27 rows)."""
    rows = [(name, *parts) for name, parts in V.PROMPT_TEMPLATES.items()]
    return spark.createDataFrame(rows, "prompt_type string, input string, output string, splitter string")


def demo_aliases(spark: SparkSession) -> DataFrame:
    """Which demo family a dataset uses when it is not its own."""
    return spark.createDataFrame(list(V.DEMO_FAMILY.items()), "dataset string, family string")


def stop_words_for(prompt_type: str) -> list[str]:
    """Words that end a completion of this prompt type, in the order they are applied."""
    words = list(V.BASE_STOP_WORDS)
    if prompt_type == "cot":
        words.append("\n\nQuestion:")
    if prompt_type in ("pal", "tool-integrated", "jiuzhang_tora"):
        return words + ["\n\n---", "```output"]
    if prompt_type in ("wizard_zs", "platypus_fs"):
        return words + ["Instruction", "Response"]
    for part, extra in (
        ("jiuzhang", "\n\n## Question"), ("numina", "\n### Problem"), ("pure", "\n\n\n"),
    ):
        if part in prompt_type:
            return words + [extra]
    return words


def stop_words(spark: SparkSession, prompt_types) -> DataFrame:
    rows = [(t, i, w) for t in prompt_types for i, w in enumerate(stop_words_for(t))]
    return spark.createDataFrame(rows, "prompt_type string, pos int, word string")


def fill(template: str | Column, slot: str, value: Column) -> Column:
    """Put ``value`` into ``{slot}``; doubled braces of the template become single ones.

    The template is split at its slot first, so braces inside the value are left alone.
    """
    t = F.lit(template) if isinstance(template, str) else template
    halves = F.split(t, r"\{" + slot + r"\}", 2)

    def single(part):
        return replace_all(part, [("{{", "{"), ("}}", "}")])

    return F.concat(
        single(F.get(halves, F.lit(0))), value, single(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    )


def demo_family(dataset: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.DEMO_FAMILY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, dataset), dataset)


def demo_lists(demos: DataFrame, shots: int) -> DataFrame:
    """First ``shots`` demos of each family as an ordered list.

    ``demos`` is the bank (family, pos, question, answer) with positions counted from 0.  The
    position filter comes first, so a list never holds more than ``shots`` entries.
    """
    shot = F.struct("pos", "question", "answer")
    return (
        demos.filter(F.col("pos") < shots)
        .groupBy("family")
        .agg(F.array_sort(F.collect_list(shot)).alias("demos"))
    )


def demo_text(demos: Column, prompt_type: str, input_template: str) -> Column:
    """Demos rendered and joined with the template's splitter."""
    _, output_template, splitter = V.PROMPT_TEMPLATES[prompt_type]
    if prompt_type == "qwen25-math-cot":
        def one(d):
            return F.concat(d["question"], F.lit("\n"), d["answer"])
    else:
        def one(d):
            return F.concat(
                fill(input_template, "input", d["question"]),
                fill(output_template, "output", d["answer"]),
            )

    return F.array_join(F.transform(demos, one), splitter)


def skips_thinking(model: str, enable_thinking: bool) -> bool:
    name = model.lower()
    return not enable_thinking and any(family in name for family in V.THINKING_MODELS)


def build_prompts(
    questions: DataFrame,
    prompt_type: str,
    demos: DataFrame | None = None,
    shots: int = 0,
    adapt_few_shot: bool = False,
    model: str = "",
    enable_thinking: bool = True,
    thinking_budget: int | None = None,
) -> DataFrame:
    """Add ``prompt``.  ``questions`` needs ``dataset``, ``question`` and ``gt``.

    The demo lists (one row per family) are joined by family, broadcast when there are few.
    """
    input_template, _, splitter = V.PROMPT_TEMPLATES[prompt_type]
    if skips_thinking(model, enable_thinking):
        input_template += V.EMPTY_THINKING
    asked = fill(input_template, "input", F.col("question"))
    adaptive = F.col("dataset").isin(V.ADAPTIVE_SHOT_DATASETS)
    if demos is None or (shots == 0 and not adapt_few_shot):
        full, df = asked, questions
    else:
        most = max(shots, 5) if adapt_few_shot else shots
        lists = demo_lists(demos, most)
        df = questions.withColumn("family", demo_family(F.col("dataset"))).join(
            lists, "family", "left"
        )
        wanted = F.when(adaptive, F.lit(5)).otherwise(F.lit(shots)) if adapt_few_shot else F.lit(shots)
        used = F.slice(F.coalesce(F.col("demos"), F.array().cast("array<struct<pos:int,question:string,answer:string>>")), F.lit(1), wanted)
        shown = demo_text(used, prompt_type, input_template)
        if prompt_type == "qwen25-math-cot":
            with_shots = fill(
                input_template, "input", F.concat(shown, F.lit(splitter), F.col("question"))
            )
        else:
            with_shots = F.concat(shown, F.lit(splitter), asked)
        plain = F.length(shown) == 0
        if adapt_few_shot:
            plain = plain | ~F.coalesce(F.col("gt").isin(V.CHOICE_LETTERS), F.lit(False))
        full = F.when(plain, asked).otherwise(with_shots)
    if prompt_type == "platypus_fs":
        full = F.concat(F.lit(V.INSTRUCTION_WRAPPER[0]), full, F.lit(V.INSTRUCTION_WRAPPER[1]))
    if prompt_type in ("tora", "tool-integrated"):
        full = F.concat(F.lit(V.CODE_GUIDELINES), full)
    full = F.trim(full)
    if thinking_budget == 0:
        full = F.concat(full, F.lit(V.EMPTY_THINKING))
    return df.withColumn("prompt", full).select(*questions.columns, "prompt")


def fan_out(prompts: DataFrame, n: int) -> DataFrame:
    """Each prompt ``n`` times, numbered by ``sample_id``."""
    return prompts.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def chat_prompt(prompt: Column, template: str) -> Column:
    """One user message rendered with a chat template that has a ``{content}`` slot."""
    return fill(template, "content", strip(prompt))


def with_thinking(prompt: Column, thinking: Column) -> Column:
    """Prompt plus thinking text, closed by the fixed sentence when it has no end marker."""
    closed = F.when(thinking.endswith(V.THINKING_END), thinking).otherwise(
        F.concat(thinking, F.lit(V.THINKING_CLOSER))
    )
    return F.concat(prompt, closed)


def scoring_text(df: DataFrame, use_solution: bool = False, prompt_type: str = "qwen25-math-cot") -> DataFrame:
    """``prompt``, ``scored_text`` and ``prompt_len`` for likelihood scoring.

    The answer part is the first completion, or the reference solution.  Lengths count
    whitespace-separated tokens.
    """
    template = V.PROMPT_TEMPLATES[prompt_type][0]
    prompt = F.trim(F.concat(fill(template, "input", strip(F.col("question"))), F.lit(V.EMPTY_THINKING)))
    answer = strip(F.col("solution" if use_solution else "code"))
    return df.withColumn("prompt", prompt).withColumn(
        "scored_text", F.trim(F.concat(F.col("prompt"), answer))
    ).withColumn("prompt_len", token_count(F.col("prompt")))


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens; the unit for every token count here."""
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+")))


def without_empty_questions(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("question") != "")
