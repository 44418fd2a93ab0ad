"""Reading and writing: round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.sweep import grouped_stats
from ..session import scratch_dir
from ..sources import files as S
from ..streaming.incremental import materialise_chunks
from .fixtures import RUNS, parsed_runs
from .registry import query, table


@query("src1_snk1_jsonl_round_trip", "SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN text END AS text FROM conversations")
def src1(spark, folder):
    chats = table(spark, folder, "conversations").withColumn("text", F.when(F.col("turn") > 0, F.col("text")))
    path = scratch_dir(spark, "jsonl")
    S.write_jsonl(chats, path)
    return S.read_jsonl(spark, path, chats.schema)


@query("src3_read_through_cache", """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_partkey, answer
 FROM (SELECT p_partkey, concat(p_size, CASE WHEN p_size % 5 = 0 THEN ';' ELSE '' END) AS answer FROM part)
 WHERE NOT contains(answer, ';')""")
def src3(spark, folder):
    mark = F.when(F.col("p_size") % 5 == 0, ";").otherwise("")
    raw = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), mark).alias("Answer")
    )
    root = scratch_dir(spark, "sets")
    # The order of the lines, file by file, is the key order.
    S.write_jsonl(raw.withColumnRenamed("Answer", "answer").orderBy("p_partkey"), f"{root}/asdiv/raw_test.jsonl")
    schema = "p_partkey long, answer string"
    S.read_dataset(spark, "asdiv", "test", root, schema)
    return S.read_dataset(spark, "asdiv", "test", root, schema)


@query("src4_tagged_files", """SELECT CASE p_partkey % 4 WHEN 0 THEN 'singleeq' WHEN 1 THEN 'singleop' WHEN 2 THEN 'addsub'
   ELSE 'multiarith' END AS type, p_partkey, CAST(p_size AS BIGINT) AS target,
   row_number() OVER (ORDER BY p_partkey % 4, p_partkey) - 1 AS idx FROM part""")
def src4(spark, folder):
    root = scratch_dir(spark, "tagged")
    df = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("long").alias("target"))
    for i, name in enumerate(V.WORD_PROBLEM_PARTS):
        S.write_jsonl(df.filter(F.col("p_partkey") % 4 == i).orderBy("p_partkey"), f"{root}/mawps/{name}.jsonl")
    got = S.read_dataset(spark, "mawps", "test", root, "p_partkey long, target long, type string")
    return got.select("type", "p_partkey", "target", "idx")


RUN_FOLDER = "concat(CASE WHEN thinking THEN 'thinking_' ELSE '' END, 'checkpoint', CAST(checkpoint AS STRING), '_max_tokens_per_call4096')"
RUN_FILE = "concat('test_qwen25-math-cot_-1_seed0_t0.0_top_k', CAST(top_k AS STRING), '_enable_thinkingFalse_s0_e-1_qwen25-math-cot_metrics.json')"


@query("src5_compile_runs", """SELECT CAST((o_custkey % 5 + 1) * 100 AS INTEGER) AS checkpoint, CAST(o_orderkey % 20 AS INTEGER) AS top_k,
   o_custkey % 2 = 0 AS is_thinking_mode, CAST(count(*) AS DOUBLE) AS accuracy
 FROM orders WHERE o_orderkey % 20 % 7 > 1 GROUP BY 1, 2, 3""")
def src5(spark, folder):
    """A metric file for each of 200 groups of orders; some are broken, some lack a number."""
    root = scratch_dir(spark, "runs")
    runs = table(spark, folder, "orders").groupBy(
        ((F.col("o_custkey") % 5 + 1) * 100).alias("checkpoint"), (F.col("o_custkey") % 2 == 0).alias("thinking"),
        (F.col("o_orderkey") % 20).alias("top_k"),
    ).agg(F.count("*").cast("double").alias("acc"))
    record = F.to_json(F.struct(
        "acc", F.lit(5).alias("num_samples"), F.lit(5).alias("num_scores"), F.lit(0).alias("timeout_samples"),
        F.lit(0).alias("empty_samples"), F.when(F.col("top_k") % 7 != 1, F.lit(60.0)).alias("time_use_in_second"),
        F.lit("1:00").alias("time_use_in_minite"),
    ))
    text = F.when(F.col("top_k") % 7 == 0, F.lit("{ not json")).otherwise(record)
    path = F.concat_ws("/", F.expr(RUN_FOLDER), F.lit("math500"), F.expr(RUN_FILE))
    S.write_texts(runs.withColumn("text", text), root, path, "text")
    return S.compile_runs(spark, root).select("checkpoint", "top_k", "is_thinking_mode", "accuracy")


@query("src6_read_matching", "SELECT o_orderkey % 50 AS k, CAST(count(*) AS DOUBLE) AS nll FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def src6(spark, folder):
    root = scratch_dir(spark, "matching")
    runs = table(spark, folder, "orders").groupBy((F.col("o_orderkey") % 50).alias("k")).agg(F.count("*").cast("double").alias("nll"))
    marker = F.when(F.col("k") % 2 == 0, "quant_").otherwise("")
    path = F.concat(F.lit("nll_results_"), marker, F.col("k").cast("string"), F.lit(".json"))
    S.write_texts(runs.withColumn("text", F.to_json(F.struct("k", "nll"), {"pretty": "true"})), root, path, "text")
    return S.read_matching(spark, root, "nll_results_*.json", "k long, nll double", "quant", keep=True).select("k", "nll")


@query("src8_prefixed_results", "SELECT o_orderkey AS idx, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def src8(spark, folder):
    root = scratch_dir(spark, "resume")
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("status"))
    # Result files of 20,000 keys each, by status; two of three statuses belong to the run.
    part = F.floor(F.col("idx") / 20_000).alias("part")
    lines = df.groupBy("status", part).agg(F.array_join(F.collect_list(F.to_json(F.struct("idx", "status"))), "\n").alias("text"))
    run = F.when(F.col("status") == "P", "run_b").otherwise("run_a")
    S.write_texts(lines, root, F.concat(F.concat_ws("_", run, "status", F.col("part").cast("string")), F.lit(".jsonl")), "text")
    return S.read_prefixed(spark, root, "run_a", df.schema)


@query("src9_split_selection", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def src9(spark, folder):
    return S.select_splits(table(spark, folder, "documents"), "en, de", "lang").select("doc_id", "lang")


@query("src10_chunked_load", "SELECT event_type, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def src10(spark, folder):
    home = scratch_dir(spark, "chunks")
    schema = table(spark, folder, "events").schema
    loaded = materialise_chunks(spark, folder, schema, "events.parquet", f"{home}/out", f"{home}/checkpoint")
    return loaded.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("snk2_write_dataset", """SELECT fmt, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars
 FROM documents, (VALUES ('parquet'), ('json'), ('csv')) f(fmt) GROUP BY 1, 2""")
def snk2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    out = None
    for fmt in S.WRITE_FORMATS:
        path = scratch_dir(spark, fmt)
        S.write_dataset(docs, path, fmt, split_col="lang")
        reader = spark.read.schema(docs.schema)
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
        counted = back.groupBy(F.lit(fmt).alias("fmt"), "lang").agg(
            F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("snk3_manifest", """SELECT 'set/docs' AS dataset_id, CAST(NULL AS VARCHAR) AS config, lang AS split, 'main' AS revision, 'parquet' AS save_format,
  'struct<doc_id:bigint,source:string,n_chars:bigint>' AS features, count(*) AS num_rows FROM documents GROUP BY lang""")
def snk3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("split"), "source", "n_chars")
    path = scratch_dir(spark, "described")
    S.write_dataset(docs, path, "parquet")
    written = spark.read.schema(docs.schema).parquet(path)
    manifest = S.dataset_manifest(written.select(*docs.columns), "set/docs", "parquet", revision="main")
    return spark.read.schema(manifest.schema).json(S.write_manifest(manifest, path))


@query("snk5_csv_export", f"""WITH {RUNS} SELECT checkpoint, round(avg(accuracy), 2) AS mean, round(stddev_samp(accuracy), 2) AS std,
  count(*) AS count FROM runs GROUP BY checkpoint""")
def snk5(spark, folder):
    path = scratch_dir(spark, "csv")
    stats = grouped_stats(parsed_runs(spark, folder), "checkpoint")
    S.write_csv(stats, path)
    return spark.read.option("header", True).schema(stats.schema).csv(path)


@query("snk8_append_if_new", "SELECT o_orderkey AS idx, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def snk8(spark, folder):
    orders = table(spark, folder, "orders")
    new = orders.select(F.col("o_orderkey").alias("idx"), "o_custkey")
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("idx"))
    path = scratch_dir(spark, "append")
    S.append_if_new(new, done, path)
    S.append_if_new(new, new, path)
    return S.read_jsonl(spark, path, new.schema)
