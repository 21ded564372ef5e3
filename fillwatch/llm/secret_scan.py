"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models of random strings and of
ordinary identifiers compared by their log-likelihood ratio."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import stored, unit_hash

#: The patterns of the base kinds, in the order of the kinds.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # leftmost runs of AKIA and more, of 20 characters at least
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 12  # characters of the shortest run that is scored
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points. The pieces between matches give the positions;
    a match whose ``group`` is shorter than ``least`` is passed over. Texts without a match are not cut."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gaps"])
        b = a + F.length(x["hits"])
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), x["values"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.length(x["values"]) >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    rows = F.zip_with(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gaps"), hits.alias("hits")), values,
                      lambda x, v: F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), v.alias("values")))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(spans_of(text, ASSIGN, 0, 2, 6), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))


def _bigrams(strings: DataFrame, label: str) -> DataFrame:
    """How often each pair of characters follows each other, by code."""
    rows = strings.where(F.length("s") > 1).select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("k"))
    code = F.ascii(F.substring("s", F.col("k"), F.lit(1))) * 128 + F.ascii(F.substring("s", F.col("k") + 1, F.lit(1)))
    return rows.select(F.lit(label).alias("label"), code.alias("code")).groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))


def train(random: DataFrame, ordinary: DataFrame, *, weight: float = 20.0, alphabet: int = 67) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII codes, random against ordinary, from labelled samples ``s`` of both kinds.

    The probability of a character after another is its count there plus ``weight`` times its overall probability, so contexts
    that a kind has not shown fall back on how common the character is in it. The random kind is an even mixture with equal
    probabilities, for keys of alphabets that the labelled strings do not show (those may all be hex). Pairs with a character
    that joins words in names and paths never speak for random. At most 2 * 128 * 128 counts reach the driver."""
    counts = {"random": np.zeros((128, 128)), "ordinary": np.zeros((128, 128))}
    for row in _bigrams(random, "random").unionByName(_bigrams(ordinary, "ordinary")).collect():
        if 0 <= row["code"] < 128 * 128:
            counts[row["label"]][divmod(row["code"], 128)] = row["n"]
    p = {}
    for label, n in counts.items():
        single = (n.sum(0) + 0.5) / (n.sum() + 0.5 * alphabet)
        p[label] = (n + weight * single) / (n.sum(1, keepdims=True) + weight)
    ratio = np.log((p["random"] + 1 / alphabet) / 2 / p["ordinary"])
    joints = [ord(c) for c in "+/_=-."]
    ratio[joints] = np.minimum(ratio[joints], 0)
    ratio[:, joints] = np.minimum(ratio[:, joints], 0)
    return ratio.ravel().tolist()


def stretches(value: Column, table: list[float], least_ratio: float) -> Column:
    """``begin, end`` (offsets, end exclusive) of the disjoint stretches of a run whose sum of the table over the pairs of
    neighbouring characters is ``least_ratio`` or more. The table is one constant of the plan.

    One fold over the pairs: a stretch starts anew where its sum falls to zero, or where it falls by ``least_ratio`` below its
    peak, and ends at its peak. So no ordinary characters before, between or after random ones weigh on them."""
    ratios = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * 128 + b + 1)

    def state(at, total, begin, peak, end, out) -> Column:
        return F.struct(at.alias("at"), total.alias("sum"), begin.alias("begin"), peak.alias("peak"), end.alias("end"), out.alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["peak"] >= least_ratio, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))).otherwise(s["out"])

    zero, none = F.lit(0), F.lit(0.0)

    def step(s: Column, p: Column) -> Column:
        at, total = s["at"] + 1, s["sum"] + F.element_at(ratios, p)
        return F.when((total <= 0) | (total <= s["peak"] - least_ratio), state(at, none, at, none, at, closed(s))) \
                .when(total > s["peak"], state(at, total, s["begin"], total, at + 1, s["out"])) \
                .otherwise(state(at, total, s["begin"], s["peak"], s["end"], s["out"]))

    return F.aggregate(pairs, state(zero, none, zero, none, zero, F.array().cast("array<struct<begin:int,end:int>>")), step, closed)


def outside(run: Column, base: Column) -> Column:
    """The parts of a run, as spans, that no span of ``base`` (sorted) covers."""
    def part(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.alias("start"), run["kind"].alias("kind"), b.alias("end"),
                                F.substring(run["value"], a - run["start"] + 1, b - a).alias("value")))

    def step(s: Column, b: Column) -> Column:
        return F.struct(F.greatest(s["at"], b["end"]).alias("at"),
                        F.when(b["start"] > s["at"], F.concat(s["out"], part(s["at"], b["start"]))).otherwise(s["out"]).alias("out"))

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    start = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("out"))
    cut = F.aggregate(touching, start, step, lambda s: F.when(s["at"] < run["end"], F.concat(s["out"], part(s["at"], run["end"]))).otherwise(s["out"]))
    return F.when(F.size(touching) > 0, cut).otherwise(F.array(run))


def markov_spans(run: Column, table: list[float], least_ratio: float) -> Column:
    """The stretches of a run as spans, each drawn out to the ends of the letters and digits around it; spans that then overlap are one."""
    value = run["value"]

    def drawn(x: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(value, F.lit(1), x["begin"]), "[A-Za-z0-9]*$", 0))
        after = F.length(F.regexp_extract(F.substring(value, x["end"] + 1, F.length(value)), "^[A-Za-z0-9]*", 0))
        return F.struct((x["begin"] - before).alias("begin"), (x["end"] + after).alias("end"))

    def merged(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["begin"].alias("begin"), x["end"].alias("end"))))
        return F.when((F.size(out) > 0) & (last["end"] > x["begin"]), joined).otherwise(F.concat(out, F.array(x)))

    found = F.aggregate(F.transform(stretches(value, table, least_ratio), drawn), F.array().cast("array<struct<begin:int,end:int>>"), merged)
    return F.transform(found, lambda x: F.struct((run["start"] + x["begin"]).alias("start"), run["kind"].alias("kind"), (run["start"] + x["end"]).alias("end"),
                                                 F.substring(value, x["begin"] + 1, x["end"] - x["begin"]).alias("value")))


def scan(docs: DataFrame, *, sample_rows: int = 5000, recurring: int = 3, least_ratio: float = 12.0) -> DataFrame:
    """``doc_id, spans`` of each row: ``spans`` is sorted by start, then kind, with ``start``, ``end`` (exclusive, code points),
    ``kind`` and ``value``.

    Base kinds are always kept. Of a run of ``LEAST`` or more credential characters, or what base spans leave of it, each stretch
    whose log-likelihood ratio is at least ``least_ratio`` is a ``markov`` span (see ``stretches``), drawn out to the ends
    of the letters and digits around it, as pairs at the edge of a random string may look ordinary. Random strings are labelled by the base patterns over all texts; ordinary identifiers
    are the other runs of 8 or more characters that occur ``recurring`` times or more in about ``sample_rows`` texts, picked by a hash
    (random strings hardly recur), and all runs there without a letter (numbers are ordinary though each comes once). Null and empty
    texts have no spans.
    Repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), spans_of(text, CANDIDATE, 3).alias("runs"),
                               ), "secret-runs")
    random = found.select(F.explode("base").alias("x")).select(F.when(F.col("x.kind") == 1, F.substring(F.col("x.value"), F.lit(5), F.length("x.value"))).otherwise(F.col("x.value")).alias("s"))
    n = max(1, found.count())
    sampled = docs.where(unit_hash("doc_id", F.lit("secrets")) * n < sample_rows).select(F.explode(F.regexp_extract_all(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " "), F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    table = train(random, sampled.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") >= recurring) | ~F.col("s").rlike("[A-Za-z]")).select("s"))
    base = F.array_sort("base")
    parts = F.filter(F.flatten(F.transform("runs", lambda r: outside(r, base))), lambda r: F.length(r["value"]) >= LEAST)
    flagged = F.flatten(F.transform(parts, lambda r: markov_spans(r, table, least_ratio)))
    return found.select("doc_id", F.sort_array(F.concat("base", flagged)).alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def counts(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
