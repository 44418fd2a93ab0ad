"""Finding the final answer in a completion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .normalize import clean_units, normalize_answer, ran_successfully  # noqa: F401
from .numbers import evaluated_text, last_number
from .pytext import (
    LETTER_CHOICE, after_last, before, count_of, find_all, first_of, last_of, let, lstrip,
    pieces, replace, rstrip, strip,
)


def boxed(c: Column) -> Column:
    """Content behind the last ``boxed``: the balanced braces, or the text up to ``$``.

    Braces that never close keep the rest of the text.  The fold runs over the pieces between
    closing braces, not over characters.
    """

    def balanced(tail):
        parts = F.split(tail, r"\}")

        def step(acc, part):
            depth = acc["depth"] + count_of(part, "{") - 1
            return F.when(acc["done"], acc).otherwise(
                F.struct(
                    depth.cast("int").alias("depth"),
                    (acc["n"] + 1).alias("n"),
                    (depth == 0).alias("done"),
                )
            )

        start = F.struct(
            F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")
        )

        def cut(parts):
            closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
            end = F.aggregate(closed, start, step)
            return let(
                end,
                lambda e: F.when(
                    e["done"], F.substr(F.array_join(F.slice(parts, F.lit(1), e["n"]), "}"), F.lit(2))
                ).otherwise(F.substr(tail, F.lit(2))),
            )

        return let(parts, cut)

    def run(tail):
        flat = r"(?s)^\{([^{}]*)\}"
        return (
            F.when(tail.rlike(flat), F.regexp_extract(tail, flat, 1))
            .when(tail.startswith("{"), balanced(tail))
            .otherwise(strip(before(tail, "$")))
        )

    return let(after_last(c, "boxed"), run)


def _edge_trim(c: Column) -> Column:
    return rstrip(rstrip(c, "."), "/")


def choice_letter(c: Column) -> Column:
    """Choice letter as the grader cleans it: the last stand-alone A-E, else the bare text."""

    def run(text):
        bare = lstrip(strip(_edge_trim(strip(text, "\n")), " "), ":")
        letter = last_of(find_all(F.upper(bare), LETTER_CHOICE))
        return _edge_trim(F.coalesce(letter, strip(strip(bare), ".")))

    return let(c, run)


def choice_answer(c: Column) -> Column:
    """Choice letter of a completion: behind an answer phrase the first letter, else the last."""
    phrases = "|".join(V.ANSWER_TRIGGERS)

    def run(text):
        repeated = count_of(text, V.ANSWER_TRIGGERS[0]) > 1
        for phrase in V.ANSWER_TRIGGERS[1:]:
            repeated = repeated | (count_of(text, phrase) > 1)
        return let(F.when(repeated, before(text, "\n\n")).otherwise(text), pick)

    def pick(text):
        def from_parts(parts):
            tail = last_of(parts)
            bare = lstrip(strip(_edge_trim(strip(tail, "\n")), " "), ":")

            def letter(bare):
                found = find_all(F.upper(bare), LETTER_CHOICE)
                chosen = F.when(F.size(parts) > 1, first_of(found)).otherwise(last_of(found))
                return _edge_trim(F.coalesce(chosen, strip(strip(bare), ".")))

            return let(bare, letter)

        return let(F.split(text, phrases), from_parts)

    return let(strip(c, "\n"), run)


def multi_choice(c: Column) -> Column:
    """Letter a-e behind "answer is" (in upper case), or ``placeholder``."""
    text = F.lower(replace(before(c, "Problem:"), "choice is", "answer is"))
    letter = F.regexp_extract(text, r"answer is \(?([abcde])\)?", 1)
    return F.coalesce(F.upper(F.nullif(letter, F.lit(""))), F.lit("placeholder"))


def typed_answer(c: Column, answer_flag: bool = True) -> Column:
    """Answer of a theorem question: True/False, an option, or a number."""
    lowered = F.lower(c)

    def has(*words):
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        return hit

    def value(text):
        if not answer_flag:
            found = last_of(find_all(text, r"-?\p{Nd}*\.?\p{Nd}+"))
            return F.coalesce(found, F.lit(""))
        cleaned = clean_units(strip(after_last(text, "=")))
        return let(
            cleaned,
            lambda t: F.coalesce(
                evaluated_text(t),
                F.when(
                    t.rlike(r"^-?[\p{Nd}.]+\s\P{Nd}+$") | t.rlike(r"^-?[\p{Nd}.]+\s[^\s]+$"),
                    before(t, " "),
                ).otherwise(t),
            ),
        )

    unboxed = F.when(c.contains("boxed"), boxed(c)).otherwise(c)
    return (
        F.when(has("yes", "true"), F.lit("True"))
        .when(has("no", "false"), F.lit("False"))
        .when(has("(a)", "(b)", "(c)", "(d)", "(e)", "(f)"), c)
        .otherwise(let(unboxed, value))
    )


def trim_answer(c: Column) -> Column:
    """Line breaks joined, one leading colon, one closing full stop and one slash dropped."""
    joined = F.regexp_replace(c, r"\n\s*", "")
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(joined, "^:", ""), r"\.\z", ""), r"/\z", ""
    )


def raw_answer(c: Column, use_last_number: bool = True) -> Column:
    """Answer text by the first rule that applies, before any cleaning."""

    def run(text):
        fixed = F.get(pieces(text, "final answer is $", 2), F.lit(1))
        chinese = F.get(pieces(text, "答案是"), F.lit(1))
        return (
            F.when(
                text.contains("final answer is $") & text.contains("$. I hope"),
                strip(before(fixed, "$. I hope")),
            )
            .when(text.contains("boxed"), boxed(text))
            .when(text.contains("he answer is"), strip(after_last(text, "he answer is")))
            .when(text.contains("final answer is"), strip(after_last(text, "final answer is")))
            .when(text.contains("答案是"), strip(before(strip(chinese), "\n\n")))
            .otherwise(last_number(text) if use_last_number else F.lit(""))
        )

    return let(replace(c, "ки"), run)


def extract_answer(c: Column, dataset: str = "math", use_last_number: bool = True, times: int = 1) -> Column:
    """Final answer of a completion, normalised (``times`` over), by the rules of ``dataset``."""
    skip_unit = dataset in V.UNSTRIPPED_DATASETS
    if dataset in V.CHOICE_DATASETS:
        # A choice answer is cleaned, not normalised, so the first round falls away.
        cleaned = choice_answer(replace(c, "ки"))
        return cleaned if times == 1 else normalize_answer(cleaned, skip_unit, times - 1)
    found = raw_answer(c, use_last_number)
    if "mmlu" in dataset:
        found = let(
            found,
            lambda t: F.when(t == "", t).otherwise(
                F.coalesce(last_of(find_all(F.upper(t), LETTER_CHOICE)), strip(strip(t), "."))
            ),
        )
    return normalize_answer(trim_answer(found), skip_unit, times)


# ---------------------------------------------------------------- completions
def completion_text(text: Column, prompt: Column) -> Column:
    """What follows the last occurrence of the prompt."""
    return strip(F.substring_index(text, prompt, -1)) if isinstance(prompt, str) else strip(
        F.call_function("substring_index", text, prompt, F.lit(-1))
    )


def cut_at_stop_words(c: Column, stop_words) -> Column:
    """Cut at each stop word, in list order."""

    def cut(word):
        return lambda t: F.when(t.contains(word), strip(before(t, word))).otherwise(t)

    for word in stop_words:
        c = let(c, cut(word))
    return c


def is_choice_text(c: Column) -> Column:
    """Only the letters A-E (or nothing at all)."""
    return c.rlike(r"^[A-E]*\z")


def repair_choice(pred: Column, gt: Column, code: Column) -> Column:
    """Bring a prediction into choice form where the gold answer is one."""
    letters = V.CHOICE_LETTERS

    def run(r):
        pred, gt = r["pred"], r["gt"]
        return (
            F.when(
                gt.isin(letters) & ~F.coalesce(pred.isin(letters), F.lit(False)),
                choice_answer(r["code"]),
            )
            .when(is_choice_text(gt) & ~is_choice_text(pred), F.regexp_replace(pred, "[^A-E]", ""))
            .otherwise(pred)
        )

    return let(F.struct(pred.alias("pred"), gt.alias("gt"), code.alias("code")), run)


def last_output_block(c: Column) -> Column:
    return F.coalesce(last_of(output_blocks(c)), F.lit(""))


def output_blocks(c: Column) -> Column:
    return find_all(c, r"(?s)```output\n(.*?)\n```", 1)


def predict(code: Column, prompt_type: str, dataset: str) -> Column:
    """Prediction of one completion: last output block or answer text; null for a failed one."""

    def run(text):
        if "program_only" in prompt_type:
            found = normalize_answer(
                last_output_block(text), skip_unit=dataset in V.UNSTRIPPED_DATASETS
            )
        else:
            found = extract_answer(text, dataset, times=2)
        return F.when((text != "") & (text != "error"), found)

    return let(code, run)
