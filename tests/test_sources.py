import json

import pytest
from pyspark.sql import functions as F

from markbook.operators import adapters as A
from markbook.operators import completions as C
from markbook.operators import prompts as P
from markbook.functions import cards
from markbook.functions import fixed_values as V
from markbook.sources import files as S
from markbook.streaming.incremental import grade_stream, graded_so_far


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n")


def test_bad_line_stops_or_is_dropped(spark, tmp_path):
    write(tmp_path / "a.jsonl", {"q": "x"}, "{broken", {"q": "y"})
    path = str(tmp_path / "a.jsonl")
    with pytest.raises(Exception):
        S.read_jsonl(spark, path, "q string").collect()
    assert S.read_jsonl(spark, path, "q string", lenient=True).count() == 2


def test_json_lines_keep_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "é 答", None)], "idx long, q string, gt_cot string")
    S.write_jsonl(df, str(tmp_path / "deep" / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "deep" / "out").glob("part-*.json"))
    assert text.strip() == '{"idx":1,"q":"é 答","gt_cot":null}'


def test_read_dataset_converts_once(spark, tmp_path):
    raw = tmp_path / "asdiv" / "raw_test.jsonl"
    write(raw, {"Body": "b", "answer": "1"}, {"Body": "c", "answer": "1; 2"}, {"Body": "d", "answer": "3"})
    df = S.read_dataset(spark, "asdiv", "test", str(tmp_path))
    assert df.columns[0] == "idx" and sorted((r["idx"], r["body"]) for r in df.collect()) == [(0, "b"), (1, "d")]
    write(raw, {"Body": "changed", "answer": "1"})
    assert S.read_dataset(spark, "asdiv", "test", str(tmp_path)).count() == 2


def test_word_problem_files_are_tagged(spark, tmp_path):
    for i, name in enumerate(V.WORD_PROBLEM_PARTS):
        write(tmp_path / "mawps" / f"{name}.jsonl", {"input": "q", "target": float(i)})
    df = S.read_dataset(spark, "mawps", "test", str(tmp_path))
    gold = A.with_ground_truth(df, "mawps")
    assert {r["type"]: (r["gt"], r["gt_cot"]) for r in gold.collect()} == {
        n: (str(i), "None") for i, n in enumerate(V.WORD_PROBLEM_PARTS)
    }


def test_file_index_follows_file_order(spark, tmp_path):
    for f in range(3):
        write(tmp_path / f"f{f}.jsonl", *[{"v": f * 1000 + i} for i in range(50 * (3 - f))])
    df = S.with_file_index(S.read_jsonl(spark, str(tmp_path), "v long"))
    values = [r["v"] for r in df.orderBy("idx").collect()]
    assert values == sorted(values) and [r["idx"] for r in df.orderBy("idx").collect()] == list(range(300))


GOOD = {
    "num_samples": 500, "num_scores": 500, "timeout_samples": 0, "empty_samples": 1, "acc": 85.4,
    "time_use_in_second": 88.6, "time_use_in_minite": "1:28",
}
NAME = "test_qwen25-math-cot_-1_seed0_t0.0_top_k{}_enable_thinking{}_s0_e-1_qwen25-math-cot_metrics.json"


def test_compile_runs(spark, tmp_path):
    def put(folder, name, record):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(record if isinstance(record, str) else json.dumps(record, indent=4))

    put("checkpoint100_max_tokens_per_call4096/math500", NAME.format(8, "False"), GOOD)
    put("thinking_checkpoint200_max_tokens_per_call32000/math500", NAME.format(2, "True"), {**GOOD, "acc": 10.0})
    put("checkpoint300/math500", NAME.format(2, "True"), "{broken")
    put("checkpoint300/math500", NAME.format(4, "True"), {"acc": 1.0})
    put("checkpoint300/math500", "other_metrics.json", GOOD)
    put("checkpoint300/gsm8k", NAME.format(2, "True"), GOOD)
    rows = S.compile_runs(spark, str(tmp_path)).orderBy("checkpoint").collect()
    assert [(r["checkpoint"], r["max_tokens_per_call"], r["is_thinking_mode"], r["top_k"], r["enable_thinking"], r["accuracy"]) for r in rows] == [
        (100, 4096, False, 8, False, 85.4), (200, 32000, True, 2, True, 10.0),
    ]


def test_names_with_and_without_marker(spark, tmp_path):
    for n, gt in ((8, ""), (2, ""), (8, "_gt_True")):
        write(tmp_path / f"nll_results_{n}{gt}.json", {"num_experts_per_tok": n, "mean_nll": n / 10})
    read = lambda keep: S.read_matching(
        spark, str(tmp_path), "nll_results_*.json", "num_experts_per_tok int, mean_nll double", "_gt_True", keep)
    assert [r["num_experts_per_tok"] for r in read(False).orderBy("num_experts_per_tok").collect()] == [2, 8]
    assert read(True).count() == 1


def test_prefix_and_resume(spark, tmp_path):
    write(tmp_path / "run_a_s0.jsonl", {"idx": 1})
    write(tmp_path / "run_a_s9.jsonl", {"idx": 2})
    write(tmp_path / "run_b_s0.jsonl", {"idx": 3})
    done = S.read_prefixed(spark, str(tmp_path), "run_a", "idx long")
    assert [r["idx"] for r in C.remaining(spark.range(5).withColumnRenamed("id", "idx"), done).orderBy("idx").collect()] == [0, 3, 4]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_dataset(spark.range(1), str(tmp_path / "x"), "arrow")


def test_append_only_when_new(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", "idx")
    path = str(tmp_path / "out")
    assert S.append_if_new(rows, rows.limit(0), path) and not S.append_if_new(rows, rows, path)
    assert S.read_jsonl(spark, path, "idx long").count() == 3


def test_adapter_unknown(spark):
    with pytest.raises(NotImplementedError):
        A.with_ground_truth(spark.range(1), "no such set")


def test_double_answers(spark):
    df = spark.createDataFrame([(27.0,), (1e7,), (0.5,)], "answer double")
    assert [r["gt"] for r in A.with_ground_truth(df, "amc23").collect()] == ["27", "10000000", "0.5"]


def test_option_map_and_true_false(spark):
    df = spark.createDataFrame([("q", {"A": "1", "B": "2"}, "A")], "question string, options map<string,string>, label string")
    assert A.with_question(df, "gaokao_math_qa").first()["question"] == "q\n选项: (A) 1 (B) 2"


def test_prompts_by_hand(spark):
    q = spark.createDataFrame([("gaokao2024_I", "What is {x}?", "B"), ("gaokao2024_I", "Why?", "7")], "dataset string, question string, gt string")
    bank = spark.createDataFrame([("gaokao", i, f"q{i}", f"a{i}") for i in range(7)], "family string, pos int, question string, answer string")
    got = [r["prompt"] for r in P.build_prompts(q, "numina", bank, 0, adapt_few_shot=True).orderBy("gt").collect()]
    assert got[0] == "### Problem: Why?\n### Solution:"
    shown = "\n\n".join(f"### Problem: q{i}\n### Solution: a{i}" for i in range(5))
    assert got[1] == shown + "\n\n### Problem: What is {x}?\n### Solution:"
    boxed = P.build_prompts(q, "mathstral").orderBy("gt").first()["prompt"]
    assert boxed == "Why?\nPlease reason step by step, and put your final answer within \\boxed{}."


def test_sample_card(spark):
    df = spark.createDataFrame([(1, "q", ["c0", "c1"], "g")], "idx int, question string, code array<string>, gt string")
    assert df.select(cards.sample_card(df, all_predictions=True)).first()[0] == (
        "Idx: 1\nQuestion: 'q'\n--------------------\ncode: c0\n--------------------\ncode: c1\nGround Truth: 'g'"
    )


def test_stream_grades_each_file_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "graded"), str(tmp_path / "checkpoint")
    schema = "idx long, sample_id int, code string, gt string"

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        grade_stream(stream, C.grade_completions, out, checkpoint)
        return {(r["idx"], r["sample_id"]): r["score"] for r in graded_so_far(spark, out).collect()}

    write(source / "a.jsonl", *[{"idx": i, "sample_id": 0, "code": f"The answer is {i}.", "gt": "1"} for i in range(3)])
    assert run() == {(0, 0): False, (1, 0): True, (2, 0): False}
    assert run() == {(0, 0): False, (1, 0): True, (2, 0): False}
    write(source / "b.jsonl", {"idx": 2, "sample_id": 0, "code": "\\boxed{1}", "gt": "1"}, {"idx": 3, "sample_id": 0, "code": "1", "gt": "1"})
    after = run()
    assert after == {(0, 0): False, (1, 0): True, (2, 0): True, (3, 0): True}
    assert spark.read.parquet(out).count() == 5
    everything = spark.read.schema(schema).json(str(source))
    once = {(r["idx"], r["sample_id"], r["score"]) for r in C.grade_completions(everything).collect()}
    assert {(k[0], k[1], v) for k, v in after.items()} <= once
