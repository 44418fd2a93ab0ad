"""Reading question sets, completions and metric files; writing results."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import fixed_values as V
from ..operators.adapters import drop_multi_answers, keep_stem_subjects, lower_columns
from ..operators.ordering import with_file_index, with_index
from ..operators.sweep import METRIC_FILE, parse_metric_file, parse_run_path

METRICS_SCHEMA = (
    "acc double, num_samples long, num_scores long, timeout_samples long, empty_samples long, "
    "time_use_in_second double, time_use_in_minite string, type_acc map<string,double>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist, on whatever file system it names?"""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_jsonl(spark: SparkSession, path, schema: StructType | str | None = None, lenient: bool = False, **options) -> DataFrame:
    """One JSON object per line.  A bad line stops the read; ``lenient`` drops it instead."""
    reader = spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST").options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_tagged_files(spark: SparkSession, paths, schema=None, tag: str = "type") -> DataFrame:
    """Several files as one table; ``tag`` holds the file's name without its ending."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return read_jsonl(spark, list(paths), schema).withColumn(tag, stem)


def load_raw(spark: SparkSession, name: str, split: str, root: str, schema=None) -> DataFrame:
    """A question set that is not in the folder under its split name yet, with ``_place``.

    Word problems come in four files; arithmetic ones as train and test; the others as a raw
    file beside the split.  ``_place`` follows the given order of the files, then the rows of a file.
    """
    folder = f"{root}/{name}"

    def placed(number: int, path: str) -> DataFrame:
        own = with_file_index(read_jsonl(spark, path, schema), "_row")
        return own.withColumn("_place", F.lit(number * 10**15).cast("long") + F.col("_row")).drop("_row")

    if name == "mawps":
        parts = [
            placed(i, f"{folder}/{part}.jsonl").withColumn("type", F.lit(part))
            for i, part in enumerate(V.WORD_PROBLEM_PARTS)
        ]
    elif name == "svamp":
        parts = [placed(i, f"{folder}/raw_{part}.jsonl") for i, part in enumerate(("train", "test"))]
    else:
        parts = [placed(0, f"{folder}/raw_{split}.jsonl")]
    raw = reduce(DataFrame.unionByName, parts)
    if name == "asdiv":
        return drop_multi_answers(raw)
    if name == "mmlu_stem":
        return keep_stem_subjects(raw)
    return raw


def read_dataset(spark: SparkSession, name: str, split: str, root: str, schema=None) -> DataFrame:
    """The question set ``root/name/split.jsonl`` with ``idx`` in front.

    When that file is missing, the raw form is numbered in file order, stored under that name once,
    and read.
    """
    path = f"{root}/{name}/{split}.jsonl"
    if not path_exists(spark, path):
        raw = lower_columns(load_raw(spark, name, split, root, schema))
        write_jsonl(with_index(raw, "_place").drop("_place"), path, mode="ignore")
    if schema is not None:
        known = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        first = spark.read.text(path).first()
        if "idx" not in known.fieldNames() and first and "idx" in json.loads(first[0]):
            schema = StructType([StructField("idx", LongType()), *known.fields])
    found = with_file_index(read_jsonl(spark, path, schema))
    return found.select("idx", *[c for c in found.columns if c != "idx"])


def read_prefixed(spark: SparkSession, folder: str, prefix: str, schema=None) -> DataFrame:
    """All result files of a run key: every ``.jsonl`` whose name starts with ``prefix``."""
    return read_jsonl(spark, folder, schema, pathGlobFilter=f"{prefix}*.jsonl")


def read_matching(spark: SparkSession, folder: str, pattern: str, schema, contains: str, keep: bool) -> DataFrame:
    """Whole-file JSON records by file name pattern, with or without a marker in the name."""
    df = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("pathGlobFilter", pattern)
        .json(folder)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )
    marked = F.col("file_path").contains(contains)
    return df.filter(marked if keep else ~marked)


def compile_runs(spark: SparkSession, root: str, subset: str = "math500", pattern: str = METRIC_FILE) -> DataFrame:
    """One row per metrics file below ``root/<run folder>/<subset>/``.

    Folders without the subset, files with another name, unreadable files and records that lack
    a required number are left out.
    """
    corrupt = "_corrupt_record"
    files = (
        spark.read.schema(f"{METRICS_SCHEMA}, {corrupt} string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .option("pathGlobFilter", "*_metrics.json")
        .option("recursiveFileLookup", True)
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("_name"))
    )
    folder = F.regexp_extract("file_path", rf"([^/]+)/{subset}/[^/]+$", 1)
    parsed = (
        files.withColumn("_folder", folder)
        .filter((F.col("_folder") != "") & F.col(corrupt).isNull())
        .withColumn("_run", parse_run_path(F.col("_folder")))
        .withColumn("_file", parse_metric_file(F.col("_name"), pattern))
        .filter(F.col("_file").isNotNull())
    )
    required = [
        "acc", "num_samples", "num_scores", "timeout_samples", "empty_samples",
        "time_use_in_second", "time_use_in_minite",
    ]
    return parsed.dropna(subset=required).select(
        "_run.checkpoint", "_run.max_tokens_per_call", "_run.is_thinking_mode",
        "_file.top_k", "_file.enable_thinking",
        F.col("acc").alias("accuracy"), "num_samples", "num_scores", "timeout_samples",
        "empty_samples", F.col("time_use_in_second").alias("time_seconds"),
        F.col("time_use_in_minite").alias("time_minutes"), "file_path",
    )


def select_splits(df: DataFrame, splits: str | None, column: str = "split") -> DataFrame:
    """Rows of the comma-separated splits; none named means all."""
    if not splits:
        return df
    return df.filter(F.col(column).isin([s.strip() for s in splits.split(",")]))


# ---------------------------------------------------------------- sinks
WRITE_FORMATS = ("parquet", "csv", "json")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, raw UTF-8, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_texts(df: DataFrame, root: str, path: Column, text: str) -> None:
    """One file per row: ``text`` at ``root/path``, on whatever file system the root names.

    For sinks whose readers expect many small files with given names.  Executors write through a text
    sink partitioned by path; the driver then moves each file to its name, so it should be given as
    many rows as there may be files.
    """
    spark = df.sparkSession
    staged = f"{root.rstrip('/')}.staged"
    df.select(path.alias("path"), F.col(text).alias("value")).write.partitionBy("path").text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(staged)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in spark.read.text(staged).select("path", F.col("_metadata.file_path").alias("file")).distinct().collect():
        target = hadoop.Path(f"{root.rstrip('/')}/{row['path']}")
        system.mkdirs(target.getParent())
        system.rename(hadoop.Path(spark._jvm.java.net.URI(row["file"])), target)
    system.delete(base, True)


def write_dataset(df: DataFrame, path: str, fmt: str, split_col: str | None = "split") -> None:
    """A dataset in one of the formats, one folder per split."""
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if split_col and split_col in df.columns:
        writer = writer.partitionBy(split_col)
    writer.save(path)


def dataset_manifest(df: DataFrame, dataset_id: str, fmt: str, config: str | None = None, revision: str | None = None, split_col: str = "split") -> DataFrame:
    """One manifest row per split: identity, format, features and row count."""
    features = df.drop(split_col).schema.simpleString()
    return df.groupBy(split_col).agg(F.count("*").alias("num_rows")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(config).cast("string").alias("config"),
        F.col(split_col).alias("split"),
        F.lit(revision).cast("string").alias("revision"),
        F.lit(fmt).alias("save_format"),
        F.lit(features).alias("features"),
        "num_rows",
    )


def write_manifest(manifest: DataFrame, dataset: str) -> str:
    """Write the rows of ``dataset_manifest`` beside the dataset, as JSON lines; returns the path."""
    path = f"{dataset.rstrip('/')}_info.json"
    write_jsonl(manifest, path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_if_new(new: DataFrame, processed: DataFrame, path: str, key: str = "idx") -> bool:
    """Append the rows not processed yet; writes nothing when there are none."""
    fresh = new.join(processed.select(key).distinct(), key, "left_anti")
    if fresh.isEmpty():
        return False
    write_jsonl(fresh.select(*new.columns), path, mode="append")
    return True
