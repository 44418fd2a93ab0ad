"""Question sets to one schema: ``question``, ``gt_cot`` and ``gt``, by dataset name.

The dataset is known per table, so each adapter is a plain select; no row decides anything by
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.extract import extract_answer
from ..functions.normalize import normalize_answer, normalize_relations
from ..functions.numbers import parse_number, python_float_text
from ..functions.pytext import before, pieces, replace, replace_all, strip


# ---------------------------------------------------------------- gold answers
def split_rationale(answer: Column) -> tuple[Column, Column]:
    parts = pieces(answer, "####")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def without_parentheses(answer: Column) -> Column:
    return F.regexp_replace(answer, r"(?d)\(.*?\)", "")


def typed_number(answer: Column, ans_type: Column) -> Column:
    """Number answers as decimal text: ``a/b``, thousands commas, percent, plain."""
    top = F.get(pieces(answer, "/"), F.lit(0))
    bottom = F.get(pieces(answer, "/"), F.lit(1))
    value = (
        F.when(answer.contains("/"), F.try_divide(parse_number(top), parse_number(bottom)))
        .when(answer.contains(","), parse_number(replace(answer, ",")))
        .when(answer.contains("%"), parse_number(before(answer, "%")) / 100)
        .otherwise(parse_number(answer))
    )
    return F.when(
        ans_type.isin("integer_number", "decimal_number"), python_float_text(value)
    ).otherwise(answer)


def choice_from_index(index: Column) -> Column:
    return F.substr(F.lit("ABCD"), index.cast("int") + 1, F.lit(1))


def choice_or_answer(choice: Column, answer: Column) -> Column:
    return F.when(F.length(choice) > 0, choice).otherwise(answer)


def first_answer(answers: Column) -> Column:
    return strip(F.try_element_at(answers, F.lit(1)), "$")


def text_of(df: DataFrame, name: str) -> Column:
    """A field as text; doubles as Python prints them."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return python_float_text(F.col(name))
    return F.col(name).cast("string")


def _gold(df: DataFrame, dataset: str) -> tuple[Column, Column]:
    """Rationale and raw gold answer."""
    col, none = F.col, F.lit(None).cast("string")
    if dataset in V.WORKED_SOLUTION_DATASETS:
        return col("solution"), extract_answer(col("solution"), dataset)
    if dataset == "gsm8k":
        return split_rationale(col("answer"))
    if dataset == "svamp":
        return col("equation" if "equation" in df.columns else "Equation"), text_of(df, _present(df, "Answer"))
    if dataset == "asdiv":
        return col("formula"), without_parentheses(col("answer"))
    if dataset == "mawps":
        return none, text_of(df, "target")
    if dataset == "tabmwp":
        return col("solution"), typed_number(col("answer"), col("ans_type"))
    if dataset == "carp_en":
        return col("steps"), col("answer")
    if dataset in ("mmlu_stem", "gpqa"):
        return none, choice_from_index(col("answer"))
    if dataset == "sat_math":
        return none, col(_present(df, "Answer"))
    if dataset == "aqua":
        return none, col("correct")
    if dataset in V.DOLLAR_ANSWER_DATASETS:
        return none, strip(replace(col("answer"), "$"))
    if dataset == "gaokao_math_qa":
        return none, col("label")
    if dataset in V.CHOICE_OR_ANSWER_DATASETS:
        return none, choice_or_answer(col("choice_answer"), col("answer"))
    if dataset == "olympiadbench":
        return none, first_answer(col("final_answer"))
    if dataset in V.PLAIN_ANSWER_DATASETS:
        return none, text_of(df, "answer")
    raise NotImplementedError(f"no adapter for dataset `{dataset}`")


def _present(df: DataFrame, name: str) -> str:
    return name if name in df.columns else name.lower()


def with_ground_truth(df: DataFrame, dataset: str) -> DataFrame:
    """Add (or refresh) ``gt_cot`` and ``gt``.

    A missing rationale becomes the text ``None``, as the published records have it.
    """
    if "gt_cot" in df.columns and "gt" in df.columns:
        if dataset == "math":
            gt = extract_answer(F.col("gt_cot"), dataset)
        elif dataset in V.UNSTRIPPED_DATASETS:
            gt = F.col("gt")
        else:
            gt = normalize_answer(F.col("gt"))
        return df.withColumn("gt", gt)
    cot, gt = _gold(df, dataset)
    if dataset in V.UNSTRIPPED_DATASETS:
        gt = normalize_relations(gt)
    else:
        gt = normalize_answer(gt)
    return df.withColumn("gt_cot", strip(F.coalesce(cot.cast("string"), F.lit("None")))).withColumn("gt", gt)


# ---------------------------------------------------------------- questions
def body_and_question(body: Column, question: Column, full_stop: bool = False) -> Column:
    body = strip(body)
    if full_stop:
        body = F.when(body.endswith("."), body).otherwise(F.concat(body, F.lit(".")))
    return F.concat_ws(" ", body, strip(question))


def python_list_text(items: Column) -> Column:
    """An array of plain texts as Python prints a list."""
    quoted = F.transform(
        items,
        lambda x: F.when(
            x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def table_question(title: Column, table: Column, question: Column, choices: Column) -> Column:
    titled = F.when(F.length(title) > 0, F.concat(F.lit('regarding "'), title, F.lit('" '))).otherwise("")
    options = F.when(
        F.size(choices) > 0,
        F.concat(F.lit(" Please select from the following options: "), python_list_text(choices)),
    ).otherwise("")
    return F.concat(
        F.lit("Read the following table "), F.coalesce(titled, F.lit("")),
        F.lit("and answer a question:\n"), table, F.lit("\n"), question,
        F.coalesce(options, F.lit("")),
    )


def lettered_options(choices: Column) -> Column:
    """``(A) x (B) y ...``"""
    shown = F.transform(
        choices,
        lambda c, i: F.concat(
            F.lit("("), F.substr(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), strip(c.cast("string"))
        ),
    )
    return F.array_join(shown, " ")


def inline_options(options: Column) -> Column:
    """``A) x B) y`` -> ``(A) x (B) y``."""
    return replace_all(F.concat(F.lit("("), strip(options)), [(f" {letter}) ", f" ({letter}) ") for letter in "BCD"])


def joined_options(options: Column) -> Column:
    """``["A)1", "B)2"]`` -> ``(A) 1 (B) 2``."""
    joined = F.concat(F.lit("("), F.array_join(options, "("))
    return strip(replace(replace(joined, "(", " ("), ")", ") "))


def keyed_options(options: Column) -> Column:
    """Option map as ``(key) value`` in key order."""
    entries = F.array_sort(F.map_entries(options))
    shown = F.transform(
        entries, lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])
    )
    return F.array_join(shown, " ")


def first_present(df: DataFrame, names=("question", "problem", "Question", "input")) -> Column:
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit("")


def answer_kind_suffix(question: Column, gt: Column) -> Column:
    """Tell the reader when the answer is true/false or yes/no."""
    lowered = F.lower(gt)
    suffix = (
        F.when(lowered.isin("true", "false"), " (True or False)")
        .when(lowered.isin("yes", "no"), " (Yes or No)")
        .otherwise("")
    )
    return F.concat(question, F.coalesce(suffix, F.lit("")))


def _asked(df: DataFrame, dataset: str) -> Column:
    col = F.col
    if dataset == "asdiv":
        return body_and_question(col("body"), col("question"))
    if dataset == "svamp":
        return body_and_question(col(_present(df, "Body")), col(_present(df, "Question")), full_stop=True)
    if dataset == "tabmwp":
        return table_question(col("table_title"), col("table"), col("question"), col("choices"))
    if dataset == "carp_en":
        return col("content")
    if dataset in ("mmlu_stem", "gpqa"):
        return F.concat(strip(col("question")), F.lit("\nAnswer Choices: "), lettered_options(col("choices")))
    if dataset == "sat_math":
        return F.concat(strip(col("question")), F.lit("\nAnswer Choices: "), inline_options(col("options")))
    if "aqua" in dataset:
        return F.concat(strip(col("question")), F.lit("\nAnswer Choices: "), joined_options(col("options")))
    if dataset == "gaokao_math_qa":
        return F.concat(strip(col("question")), F.lit("\n选项: "), keyed_options(col("options")))
    return first_present(df)


def with_question(df: DataFrame, dataset: str) -> DataFrame:
    """Rewrite ``question`` into its final text; needs the raw gold fields or ``gt``."""
    if "gt" in df.columns and "gt_cot" not in df.columns:
        known = df
    else:
        known = with_ground_truth(df, dataset)
    asked = strip(answer_kind_suffix(_asked(df, dataset), F.col("gt")))
    return known.withColumn("question", asked)


# ---------------------------------------------------------------- row and column shaping
def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def keep_carried(df: DataFrame, always=("idx", "question", "gt_cot", "gt", "prompt")) -> DataFrame:
    """The canonical fields and whatever optional ones the set has."""
    names = [c for c in [*always, *V.CARRIED_FIELDS] if c in df.columns]
    return df.select(*names)


def drop_multi_answers(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("answer").contains(";"))


def keep_stem_subjects(df: DataFrame) -> DataFrame:
    renamed = df.withColumnRenamed("subject", "type")
    return renamed.filter(F.col("type").isin(V.STEM_SUBJECTS))


def keep_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def drop_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(~F.col(column).isin(list(values)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
