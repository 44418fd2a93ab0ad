"""Display texts: previews, sample cards, slugs, run names, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .pytext import quoted


def preview(text: Column, chars: int = V.PREVIEW_CHARS) -> Column:
    short = F.concat(F.left(text, F.lit(chars)), F.lit("..."))
    return F.when(F.length(text) > chars, short).otherwise(text)


def minutes_seconds(seconds: Column) -> Column:
    """``m:ss``"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), whole % 60)


def dataset_slug(dataset_id: Column, config: Column | None = None) -> Column:
    slug = F.replace(dataset_id, F.lit("/"), F.lit("--"))
    if config is None:
        return slug
    return F.concat_ws("--", slug, F.nullif(config, F.lit("")))


def run_name(fields: dict[str, Column], split: Column, prompt_type: Column) -> Column:
    """Run file prefix from its settings, in the fixed order of the setting names.

    Fixed values: the labels in front of each setting.
    """
    labels = [
        ("num_test_sample", ""), ("seed", "seed"), ("temperature", "t"), ("top_k", "top_k"),
        ("enable_thinking", "enable_thinking"), ("quantize_kv", "quantize_kv"),
        ("quantize_model", "quantize_model"), ("wbits", "wbits"), ("abits", "abits"),
        ("groupsize", "groupsize"), ("n_sampling", "n_sampling"),
    ]
    parts = [F.concat(F.lit(label), fields[name].cast("string")) for name, label in labels if name in fields]
    return F.concat_ws("_", split, prompt_type, *parts)


def out_file_name(prefix: Column, start: Column, end: Column) -> Column:
    return F.concat(
        prefix, F.lit("_s"), start.cast("string"), F.lit("_e"), end.cast("string"), F.lit(".jsonl")
    )


def shown(df: DataFrame, name: str) -> Column:
    """A field as Python shows it: quoted text, True and False, lists of either."""
    kind = df.schema[name].dataType.simpleString()

    def one(c: Column, kind: str) -> Column:
        if kind == "string":
            return F.coalesce(quoted(c), F.lit("None"))
        if kind == "boolean":
            return F.when(c, "True").when(~c, "False").otherwise("None")
        return F.coalesce(c.cast("string"), F.lit("None"))

    if kind.startswith("array<"):
        items = F.transform(F.col(name), lambda x: one(x, kind[6:-1]))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return one(F.col(name), kind)


def sample_card(df: DataFrame, all_predictions: bool = False) -> Column:
    """One sample as labelled lines; fields the frame lacks are left out."""
    lines = []
    for key in ("idx", "type", "level", "dataset"):
        if key in df.columns:
            lines.append(F.concat(F.lit(f"{key.capitalize()}: "), F.col(key).cast("string")))
    lines.append(F.concat(F.lit("Question: "), quoted(F.col("question"))))
    if "code" in df.columns:
        if all_predictions:
            each = F.transform(
                F.col("code"), lambda c: F.concat(F.lit("-" * 20 + "\ncode: "), c)
            )
            lines.append(F.array_join(each, "\n"))
            if "report" in df.columns:
                lines.append(F.concat(F.lit("Execution: "), shown(df, "report")))
        else:
            lines.append(F.concat(F.lit("Solution:\n "), F.try_element_at(F.col("code"), F.lit(1))))
            if "report" in df.columns:
                lines.append(F.concat(F.lit("Execution: "), F.try_element_at(F.col("report"), F.lit(1))))
    if "pred" in df.columns:
        lines.append(F.concat(F.lit("Prediction: "), quoted(F.try_element_at(F.col("pred"), F.lit(1)))))
    # The labels of the closing fields.
    for key, label in (("gt", "Ground Truth"), ("score", "Score"), ("unit", "unit"), ("gt_cot", "Reference CoT")):
        if key in df.columns:
            lines.append(F.concat(F.lit(f"{label}: "), shown(df, key)))
    return F.concat_ws("\n", *lines)
