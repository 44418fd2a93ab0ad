"""Personal data by weak supervision, in native columns only.

Plain rules find the base spans: e-mail and IP addresses, card and phone numbers.  Looser patterns
propose further candidates: numbers that stand next to other numbers and so spoil a base match
(cards still have to pass the checksum), local phone forms, and secrets (long keys).  Three labelers vote on every candidate, base or not:
its form (regex and checksum), a gazetteer (issuers, domains, area forms, key words), and its context
(cue words before it, letters or digits that touch it).  Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind, without labels; its posteriors
train a naive Bayes span classifier over form features, which decides on the candidates that aren't
base.  Base spans always stay.

The statistics cover all documents.  What reaches the driver is one flag for each combination of
kind and features (under 4,000 by construction).  Rows are independent of each other, so repeated
rows give equal results; a null text is an empty one, without spans; an empty table gives an empty
table and a classifier that accepts nothing.  Patterns are possessive and anchored at the start of a
run, so long texts take linear time and no deep recursion; so do places, which are running sums by
blocks, and overlaps, which are found by halving.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.pytext import let

from .common import stored

#: Kinds as they are listed in results.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
VOTES = (-1, 0, 1)
ROUNDS = 25

# Base patterns.  A match can only begin where a run of its first class begins, or where the last
# match ended.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Runs of digits with single separators are the matches of the base pattern; only those of 12 to 19
# digits can pass.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"

# Looser patterns.
_LOOSE = {
    PHONE: r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9+.-]))\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    CARD: r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{12,19}+)(?![0-9])",
    SECRET: r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+",
}

# Gazetteers and cue words.
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
_ISSUERS = r"^(?:4|5[0-9]|2[2-7]|3[4-7]|6[0-9]|30)"
_KEYWORDS = r"(?i)(?:token|password|passwd|pwd|secret|key|bearer|credential)\W{0,6}$"
_CUES = {
    EMAIL: r"(?i)(?:mail|contact|write|address|reach)\W{1,4}\w{0,6}\W{0,3}$",
    IP: r"(?i)(?:ip|host|server|address|login|from)\W{1,4}$",
    CARD: r"(?i)(?:card|visa|credit|debit|account|number|iban)\W{1,4}$",
    PHONE: r"(?i)(?:phone|call|tel|fax|mobile|cell|contact)\W{1,4}$",
    SECRET: r"[=:]\s?[\"']?$",
}


#: Values that one step of a running fold holds.
BLOCK = 128


def _running(values: Column, step) -> Column:
    """Running results of ``step(so far, value)`` from 0 up over an array of integers.

    Folds append to an array that is copied each time, so they go over blocks: inside each of them, over
    what the blocks come to, and then each block is moved by what came before it.
    """
    last = lambda xs: F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(0))

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda done, x: F.array_append(done, step(last(done), x)))

    def whole(xs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")))
        return let(F.transform(blocks, lambda b: scan(F.slice(xs, b * BLOCK + 1, BLOCK))), moved)

    def moved(parts: Column) -> Column:
        def one(before: Column) -> Column:
            return F.flatten(
                F.transform(
                    parts,
                    lambda xs, i: let(F.coalesce(F.get(before, i - 1), F.lit(0)), lambda was: F.transform(xs, lambda x: step(was, x))),
                )
            )

        return let(scan(F.transform(parts, last)), one)

    return let(values, whole)


def _matches(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, value, left, right>>: where a pattern matches, in code points.

    From its matches and the texts between them, both columns of their own, so that no element scans
    the text again.  ``left`` is up to 24 characters before the match, ``right`` the one after it.
    """
    n = F.size(found)
    earlier = F.slice(gaps, F.lit(1), n)
    ends = _running(F.zip_with(found, earlier, lambda m, g: F.length(m) + F.length(g)), lambda a, b: a + b)
    zipped = F.arrays_zip(ends.alias("end"), found.alias("value"), earlier.alias("gap"), F.slice(gaps, F.lit(2), n).alias("next"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            (z["end"] - F.length(z["value"])).alias("start"),
            z["end"].alias("end"),
            z["value"].alias("value"),
            F.substring(z["gap"], -24, 24).alias("left"),
            F.substring(z["next"], 1, 1).alias("right"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, its digits summed up."""
    figures = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(
        F.transform(
            figures,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))
            ),
        ),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _passes(kind: int, value: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == CARD:
        return F.length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == PHONE:
        return F.length(_digits(value)).between(9, 15)
    return value.rlike(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(kind: int, x: Column) -> list[Column]:
    """The labelers' votes on a match: form, gazetteer, context."""
    value, left, right = x["value"], x["left"], x["right"]
    if kind == PHONE:
        form = _vote(F.length(_digits(value)).between(10, 13), ~_passes(kind, value))
    else:
        form = _vote(_passes(kind, value), ~_passes(kind, value))
    listed = {
        EMAIL: _vote(value.rlike(_DOMAINS), ~value.rlike(r"[A-Za-z]{2,}$")),
        IP: _vote(value.rlike(r"^[1-9][0-9]{0,2}\."), value.rlike(r"^0+\.")),
        CARD: _vote(value.rlike(_ISSUERS), value.rlike(r"^(?:0|([0-9])\1{11})")),
        PHONE: _vote(value.rlike(r"^\+|^\([0-9]{3}\)"), value.rlike(r"([0-9])\1{6}")),
        SECRET: _vote(left.rlike(_KEYWORDS), value.rlike(r"^[0-9]+$|(?:.)\1{7}|[_/+-]{3}")),
    }[kind]
    touched = left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]")
    return [form, listed, _vote(left.rlike(_CUES[kind]), touched)]


def _features(x: Column) -> Column:
    """Form of a match as one text: length, share of digits, what stands before and after it."""
    value = x["value"]
    side = lambda c: (
        F.when(c == "", "e").when(c.rlike(r"^\s$"), "s").when(c.rlike(r"^[\p{L}\p{N}]$"), "w").otherwise("p")
    )
    share = F.floor(4 * F.length(_digits(value)) / F.length(value))
    return F.concat_ws(
        ".",
        F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string"),
        share.cast("string"),
        side(F.substring(x["left"], -1, 1)),
        side(x["right"]),
    )


def _candidates(kind: int, found: Column, base: bool) -> Column:
    def one(x: Column) -> Column:
        form, listed, context = _votes(kind, x)
        return F.struct(
            x["start"].alias("start"),
            F.lit(kind).alias("kind"),
            x["end"].alias("end"),
            F.lit(base).alias("base"),
            *(v.cast("int").alias(n) for n, v in zip("abc", (form, listed, context))),
            _features(x).alias("form"),
        )

    sure = base or kind == CARD
    return F.transform(F.filter(found, lambda x: _passes(kind, x["value"])) if sure else found, one)


def _meets(x: Column, spans: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and apart: only the last one that
    begins before its end can, and halving finds it."""
    halves = F.sequence(F.length(F.bin(F.size(spans))) - 1, F.lit(0), F.lit(-1))

    def step(at: Column, bit: Column) -> Column:
        further = at + F.call_function("shiftleft", F.lit(1), bit)
        return F.when(F.get(spans, further - 1)["start"] < x["end"], further).otherwise(at)

    before = F.aggregate(halves, F.lit(0), step)
    return F.coalesce(F.get(spans, before - 1)["end"] > x["start"], F.lit(False))


def _apart(extra: str, taken: list[str]) -> Column:
    """Those of ``extra`` that overlap none of the columns ``taken``, each in order and apart."""
    return F.filter(extra, lambda x: ~reduce(lambda a, b: a | b, (_meets(x, F.col(t)) for t in taken)))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__base`` and ``__more``: arrays of candidates with votes and form."""
    base = {EMAIL: _EMAIL, IP: _IP, CARD: _CARD, PHONE: _PHONE}
    patterns = {f"b{k}": p for k, p in base.items()} | {f"l{k}": p for k, p in _LOOSE.items()}
    # Most texts have neither "@" nor a digit and are scanned once.
    read = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    read = read.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    at, plus = F.instr("__text", "@") > 0, F.instr("__text", "+") > 0
    worth = {f"b{EMAIL}": at, f"b{PHONE}": F.col("__digit") & plus}
    none = F.array().cast("array<string>")
    found = read.select(
        "*",
        *(
            F.when(worth.get(k, F.col("__digit")), F.regexp_extract_all("__text", F.lit(p), F.lit(0)))
            .otherwise(none)
            .alias(f"__m_{k}")
            for k, p in patterns.items()
        ),
    )
    found = found.select(
        "*",
        *(F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(none).alias(f"__g_{k}") for k, p in patterns.items()),
    )
    spans = lambda k: _matches(F.col(f"__m_{k}"), F.col(f"__g_{k}"))
    taken = [f"__base{k}" for k in base]
    found = found.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        *(_candidates(k, spans(f"b{k}"), True).alias(f"__base{k}") for k in base),
        *(_candidates(k, spans(f"l{k}"), False).alias(f"__loose{k}") for k in _LOOSE),
    )
    for kind in _LOOSE:
        found = found.withColumn(f"__apart{kind}", _apart(f"__loose{kind}", taken))
        taken = [*taken, f"__apart{kind}"]
    return found.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.array_sort(F.concat(*(f"__base{k}" for k in base))).alias("__base"),
        F.array_sort(F.concat(*(f"__apart{k}" for k in _LOOSE))).alias("__more"),
    )


def _posteriors(patterns: DataFrame) -> DataFrame:
    """(kind, a, b, c, q): probability that a candidate with these votes is real.

    ``patterns`` has kind, a, b, c and n.  Each kind has at most 27 patterns, kept as one array, and
    the steps of expectation-maximisation are a fold over the rounds.  It starts at the share of
    yes-votes; one imagined candidate of each kind, on which all labelers are right, and one on which
    they are, saying no, keep every probability inside 0 and 1.
    """
    rows = patterns.groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct("a", "b", "c", F.col("n").cast("double").alias("n")))).alias("rows")
    )
    start = F.transform("rows", lambda r: (F.lit(3.5) + r["a"] + r["b"] + r["c"]) / 7.0)

    def mass(zipped: Column, real: bool, when=None) -> Column:
        part = lambda z: z["rows"]["n"] * (z["q"] if real else 1 - z["q"])
        return F.aggregate(
            zipped, F.lit(0.0), lambda s, z: s + (part(z) if when is None else F.when(when(z), part(z)).otherwise(0.0))
        )

    def step(q: Column, _: Column) -> Column:
        zipped = F.arrays_zip(F.col("rows"), q.alias("q"))
        zipped = F.transform(zipped, lambda z: F.struct(z["rows"].alias("rows"), z["q"].alias("q")))
        ratios = [F.log((mass(zipped, True) + 1) / (mass(zipped, False) + 1))]
        for voter in "abc":
            for vote in VOTES:
                said = lambda z, voter=voter, vote=vote: z["rows"][voter] == vote
                prior = {True: {1: 1.0, 0: 0.5, -1: 0.1}, False: {1: 0.1, 0: 0.5, -1: 1.0}}
                yes = (mass(zipped, True, said) + prior[True][vote]) / (mass(zipped, True) + 1.6)
                no = (mass(zipped, False, said) + prior[False][vote]) / (mass(zipped, False) + 1.6)
                ratios.append(F.log(yes / no))
        bound = F.array(F.array(*ratios))

        def rate(p: Column) -> Column:
            def one(r: Column) -> Column:
                total = F.get(p, F.lit(0))
                for i, voter in enumerate("abc"):
                    total = total + F.get(p, (r[voter] + 2 + 3 * i).cast("int"))
                return 1 / (1 + F.exp(-total))

            return F.transform(F.col("rows"), one)

        return F.get(F.transform(bound, rate), F.lit(0))

    fitted = rows.withColumn("q", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    each = fitted.select("kind", F.explode(F.arrays_zip("rows", "q")).alias("z"))
    return each.select("kind", "z.rows.a", "z.rows.b", "z.rows.c", F.col("z.q").alias("q"))


def fit(docs: DataFrame) -> list[str]:
    """Train on all documents; returns ``kind.form`` of the forms that the classifier accepts."""
    each = (
        with_candidates(docs.select("text"))
        .select(F.explode(F.concat("__base", "__more")).alias("x"))
        .groupBy("x.kind", "x.a", "x.b", "x.c", "x.form")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Read twice below; the texts should not be.
    each = stored(each, "forms")
    posterior = _posteriors(each.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")))
    soft = (
        each.join(posterior, ["kind", "a", "b", "c"])
        .groupBy("kind", "form")
        .agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no"))
    )
    parts = soft.select("kind", "form", "yes", "no", F.posexplode(F.split("form", r"\.")).alias("at", "value"))
    ratio = parts.groupBy("kind", "at", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    whole = soft.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    weights = ratio.join(whole, "kind").select(
        "kind",
        "at",
        "value",
        F.log(((F.col("yes") + 0.5) / (F.col("all_yes") + 5)) / ((F.col("no") + 0.5) / (F.col("all_no") + 5))).alias("w"),
        F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"),
    )
    decided = (
        parts.join(weights, ["kind", "at", "value"])
        .groupBy("kind", "form")
        .agg((F.sum("w") + F.first("prior")).alias("z"))
        .where("z > 0")
    )
    return sorted(f"{r['kind']}.{r['form']}" for r in decided.select("kind", "form").collect())


def with_spans(docs: DataFrame, accepted: list[str], text: str = "text") -> DataFrame:
    """Adds ``__base`` and ``__spans``: base spans, and those with the accepted candidates."""
    found = with_candidates(docs, text)
    known = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")
    more = F.filter("__more", lambda x: F.array_contains(known, F.concat_ws(".", x["kind"].cast("string"), x["form"])))
    return found.withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__more")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
    )


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and spans of every document."""
    spans = with_spans(docs.select("doc_id", "text"), fit(docs))
    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in (EMAIL, IP, CARD, PHONE)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_listed("__base").cast("binary"), 256).alias("base_sha256"),
        _listed("__spans").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind, as ``<EMAIL>``; n_chars follows the text.

    Of spans that overlap the first one names the kind, and the text up to the end of the last goes.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def between(points: Column, start: Column, end: Column) -> Column:
        """Text between two places of a text in four bytes a character, where a place is found at once."""
        return F.decode(F.substring(points, 4 * start + 1, 4 * (end - start)), "UTF-32")

    def pieces(points: Column, reach: Column) -> Column:
        earlier = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        marks = F.zip_with(
            "__spans",
            earlier,
            lambda x, at: F.when(
                x["start"] >= at, F.concat(between(points, at, x["start"]), F.get(names, x["kind"]))
            ).otherwise(""),
        )
        last = between(points, F.element_at(reach, -1), F.call_function("div", F.octet_length(points), F.lit(4)).cast("int"))
        return F.concat(F.array_join(marks, ""), last)

    ends = _running(F.transform("__spans", lambda x: x["end"]), F.greatest)
    replaced = let(F.encode("text", "UTF-32"), lambda points: let(ends, lambda reach: pieces(points, reach)))
    text = F.when(F.size("__spans") > 0, replaced).otherwise(F.col("text"))
    marked = with_spans(docs, fit(docs)).withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.size("__spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        marked = marked.withColumn("n_chars", changed)
    return marked.select(*(F.col(f"`{c}`") for c in docs.columns))
