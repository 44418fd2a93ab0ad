import random
import time

from pyspark.sql import functions as F

from markbook.functions import trajectory as T

FAILED = "Hi\n```python\nimport x\nprint(1)\n```\n```output\nError: bad\n```\nmore\n```python\na=1\nprint(a)\n```\n```output\n1\n```\nend"


def test_blocks(apply):
    (blocks,) = apply(T.trajectory, [FAILED])
    assert [(b["role"], b["content"]) for b in blocks] == [
        ("rationale", "Hi\n"), ("program", "import x\nprint(1)\n"), ("output", "Error: bad\n"), ("rationale", "more\n"),
        ("program", "a=1\nprint(a)\n"), ("output", "1\n"), ("rationale", "end"),
    ]


def test_bad_nesting(apply):
    bad = ["```python\n```", "```python\nx\n```python\ny", "```python\nx\n```\n\n```output\n1\n```"]
    assert apply(T.trajectory, bad) == [None] * 3
    assert apply(T.programs, bad[:1]) == [T.INVALID_PROGRAM]


def test_round_trip(apply):
    texts = [FAILED, "plain", "", "a\n\nb\n", "```python\nx\n```\n```output\n```\n"]
    assert apply(lambda c: T.trajectory_text(T.trajectory(c)), texts) == texts


def test_programs(apply):
    more = FAILED + "\n```python\nz=3\nprint(z)\n```"
    assert apply(T.programs, [FAILED, more]) == ["import x\na=1\nprint(a)\n", "import x\na=1\n\nz=3\nprint(z)\n"]
    assert apply(lambda c: T.programs(c, last_only=True), [more, "no code"]) == ["z=3\nprint(z)\n", ""]


def test_outputs(apply):
    assert apply(lambda c: F.array_join(T.output_blocks(c), "|"), [FAILED]) == ["Error: bad|1"]


def plain_blocks(text):
    """The state machine over lines, in plain Python; None where the fences do not nest."""
    out, role, content = [], "rationale", ""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line == "```python":
            if role != "rationale":
                return None
            out += [(role, content)] if content else []
            role, content = "program", ""
        elif role == "program" and line == "```":
            if not content:
                return None
            out, role, content = out + [(role, content)], "output", ""
        elif role == "output" and line.startswith("```output"):
            if content:
                return None
        elif role == "output" and line == "```":
            out, role, content = out + [(role, content)], "rationale", ""
        else:
            content += line + ("\n" if i < len(lines) - 1 else "")
    return out + ([(role, content)] if content else [])


def plain_programs(text):
    blocks = plain_blocks(text)
    if blocks is None:
        return T.INVALID_PROGRAM
    bad = ["error", "exception", "no algorithms", "cannot", "nan", "..."]
    kept, imports = [], []
    for i, (role, content) in enumerate(blocks):
        if role == "program":
            if i == len(blocks) - 1 or not any(k in blocks[i + 1][1].strip().lower() for k in bad):
                kept.append(content)
            else:
                imports += [x for x in content.split("\n") if x.startswith(("import", "from"))]
    kept = kept or [""]
    if imports:
        kept[0] = "\n".join(imports) + "\n" + kept[0]
    quiet = ["\n".join(x for x in p.split("\n") if not x.strip().startswith("print(")) for p in kept[:-1]]
    return "\n".join(quiet + kept[-1:])


def test_random_fences_against_the_state_machine(apply):
    draw = random.Random(8)
    lines = ["```python", "```", "```output", "```output x", "```foo", "", "x = 1", " print(x)", "import y", "Error", "\x0bprint(2)", "1"]
    cycle = ["```python", "import z", "print(z)", "```", "```output", "Error", "```", "```python", "a", "```", "1", "```"]
    texts = ["\n".join(draw.choices(lines, k=draw.randrange(9))) for _ in range(1500)]
    texts += ["\n".join(cycle[: draw.randrange(13)] + draw.choices(lines, k=draw.randrange(5))) for _ in range(1500)]
    texts += [draw.choice(["", "a\n"]) + "\n".join(x for x in cycle * 2 if draw.random() < 0.9) for _ in range(1500)]
    got = apply(T.trajectory, texts)
    assert [b and [tuple(x) for x in b] for b in got] == [plain_blocks(t) for t in texts]
    assert apply(T.programs, texts) == [plain_programs(t) for t in texts]
    assert sum(plain_blocks(t) is not None for t in texts) > 500


def test_ten_thousand_fences_in_linear_time(apply):
    def text(n):
        return "\n".join(f"step {i}\n```python\nx = {i}\nprint(x)\n```\n```output\n{i}\n```" for i in range(n))

    apply(T.programs, [text(10)])
    start = time.time()
    (blocks,) = apply(T.trajectory, [text(2500)])
    (program,) = apply(T.programs, [text(2500)])
    assert len(blocks) == 7500 and program == plain_programs(text(2500))
    assert time.time() - start < 20


def test_blocks_are_cut_once(spark):
    """No filter below the explode, which would run every rule a second time."""
    from markbook.plans import QUERIES

    plan = QUERIES["trj1_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```python") == 3  # twice in the text it composes, once in the pattern that cuts it
