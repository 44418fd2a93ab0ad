"""Group-wise quantisation arithmetic on float arrays, and the memory-traffic cost model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import let


def group_params(c: Column, bits: int, groupsize: int, sym: bool = False) -> Column:
    """``array<struct<lo, hi, scale, zero>>``, one entry per run of ``groupsize`` values.

    The range always spans zero; an all-zero group gets the range [-1, 1].
    """
    maxq = float(2**bits - 1)

    def run(v):
        groups = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / groupsize).cast("int"))
        return F.transform(groups, lambda g: params(F.slice(v, g * groupsize + 1, F.lit(groupsize))))

    def params(values):
        part = F.transform(values, lambda x: x.cast("double"))
        ends = F.struct(
            F.least(F.array_min(part), F.lit(0.0)).alias("lo"),
            F.greatest(F.array_max(part), F.lit(0.0)).alias("hi"),
        )
        return let(ends, widen)

    def widen(e):
        lo, hi = e["lo"], e["hi"]
        if sym:
            hi = F.greatest(F.abs(e["lo"]), e["hi"])
            lo = F.when(e["lo"] < 0, -hi).otherwise(e["lo"])
        empty = (lo == 0) & (hi == 0)
        span = F.struct(
            F.when(empty, F.lit(-1.0)).otherwise(lo).alias("lo"),
            F.when(empty, F.lit(1.0)).otherwise(hi).alias("hi"),
        )
        return let(span, scale)

    def scale(s):
        step = (s["hi"] - s["lo"]) / maxq
        zero = F.lit((maxq + 1) / 2) if sym else F.rint(-s["lo"] / step)
        return F.struct(
            s["lo"].alias("lo"), s["hi"].alias("hi"), step.alias("scale"), zero.alias("zero")
        )

    return let(c, run)


def fake_quantize(c: Column, bits: int, groupsize: int, sym: bool = False) -> Column:
    """Quantise to ``bits`` and back, group by group (rounding half to even)."""
    maxq = float(2**bits - 1)

    def run(values):
        return let(group_params(values, bits, groupsize, sym), lambda p: spend(values, p))

    def spend(values, params):
        def one(x, i):
            p = F.get(params, F.floor(i / groupsize).cast("int"))
            q = F.greatest(
                F.least(F.rint(x.cast("double") / p["scale"]) + p["zero"], F.lit(maxq)), F.lit(0.0)
            )
            return p["scale"] * (q - p["zero"])

        return F.transform(values, one)

    return let(c, run)


def fake_ternary(c: Column, groupsize: int) -> Column:
    """Three levels per group: its maximum, its minimum and zero, cut at half of each."""

    def run(values):
        return let(group_params(values, 1, groupsize), lambda p: spend(values, p))

    def spend(values, params):
        def one(x, i):
            p = F.get(params, F.floor(i / groupsize).cast("int"))
            number = x.cast("double")
            high = F.when(number > p["hi"] / 2, p["hi"]).otherwise(0.0)
            return high + F.when(number < p["lo"] / 2, p["lo"]).otherwise(0.0)

        return F.transform(values, one)

    return let(c, run)


def bytes_per_value(bits: Column, groupsize) -> Column:
    """Bytes per stored value: two for 16 bits, else the packed bits plus group overhead."""
    size = groupsize if isinstance(groupsize, Column) else F.lit(groupsize)
    packed = ((size * bits + 2 * 16) / size) / 8
    return F.when(bits == 16, F.lit(2.0)).otherwise(packed.cast("double"))


def memory_cost(
    input_tokens: Column, output_tokens: Column, wbits: Column, abits: Column, groupsize, model: dict
) -> Column:
    """``struct<cost, weight_ops, kv_ops>`` of decoding one question's samples together.

    ``output_tokens`` is an array with one length per sample.  ``model`` names num_layers,
    hidden_dim, intermediate_dim, num_kv_heads and num_heads (numbers or columns).
    """
    m = {k: v if isinstance(v, Column) else F.lit(v) for k, v in model.items()}
    hidden = m["hidden_dim"].cast("double")
    layers = m["num_layers"]
    head_dim = F.floor(m["hidden_dim"] / m["num_heads"]).cast("double")
    weights = layers * (4 * hidden * hidden + 3 * hidden * m["intermediate_dim"])
    longest = F.array_max(output_tokens)
    weight_ops = (longest + 1) * weights * bytes_per_value(wbits, groupsize)
    per_token = 2 * layers * head_dim * m["num_kv_heads"] * bytes_per_value(abits, groupsize)
    grown = F.aggregate(
        output_tokens, F.lit(0.0), lambda acc, n: acc + n.cast("double") * (n + 1) / 2
    )
    kv_ops = grown * per_token + longest * (per_token * input_tokens)
    return F.struct(
        (weight_ops + kv_ops).alias("cost"), weight_ops.alias("weight_ops"), kv_ops.alias("kv_ops")
    )


def mean_negative_logprob(lp: Column, prompt_len: Column) -> Column:
    """Minus the mean log-probability behind the prompt."""
    rest = F.slice(lp, prompt_len + 1, F.greatest(F.size(lp) - prompt_len, F.lit(0)))
    return let(
        rest, lambda r: F.try_divide(-F.aggregate(r, F.lit(0.0), lambda a, x: a + x), F.size(r))
    )


def mask_all_but_last(tokens: Column, ignored: int = -100) -> Column:
    """Training targets: only the last one counts."""
    def run(t):
        last = F.size(t) - 1
        kept = F.slice(t, F.greatest(last + 1, F.lit(1)), F.lit(1))
        return F.concat(F.array_repeat(F.lit(ignored), F.greatest(last, F.lit(0))), kept)

    return let(tokens, run)
