"""Quality rules with robust multivariate outliers.

Minimum-covariance-determinant estimates per language and source, or of the next coarser level that has rows enough (the
language, then all rows): concentration steps take the ``share`` of a group's
rows with the smallest Mahalanobis distances and re-estimate centre and scatter from them, all groups side by side.
A row whose transformed statistics lie beyond a chi-square quantile of its group is rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import find_words, map_rows, stored

SYMBOLS = "#*$%&|<>"
find_capitals = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]").findall
#: Smallest standard deviation that each transformed statistic is given. Shares are log1p of percent, so a statistic that
#: is zero in nearly all texts of a group still needs fourteen percent and more to stand out alone.
FLOORS = (0.08, 0.45, 0.45, 0.45, 0.45)
P = len(FLOORS)
EVERYTHING = "[]"  # the group of all rows


def text_statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the transformed statistics."""
    text = text or ""
    words = find_words(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(text.split("\n"))
    full = [(line, k) for line, k in lines.items() if k > 1 and find_words(line)]
    dup = sum(k - 1 for _, k in full)
    repeat = 0
    if n > 3:
        code = pd.factorize(np.array(words, object))[0].astype(np.int64)
        base = int(code.max()) + 1
        if base < 2_000_000:
            key = (code[:-2] * base + code[1:-1]) * base + code[2:]
        else:
            pair = pd.factorize(code[:-1] * base + code[1:])[0].astype(np.int64)
            key = pair[:-1] * base + code[2:]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[where] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[again + k] = True
        repeat = int(hit.sum())
    upper = len(find_capitals(text))
    percent = lambda x, of: math.log1p(100.0 * x / max(of, 1))
    return (n, chars, symbols, dup, repeat,
            [math.log(chars / n) if n else 0.0, percent(symbols, chars), percent(dup, sum(lines.values())), percent(repeat, n), percent(upper, chars)])


def statistics(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [text_statistics(t) for t in batch.column(2).to_pylist()]
        cols = [pa.array([x[k] for x in got], pa.int64()) for k in range(5)] + [pa.array([x[5] for x in got], pa.list_(pa.float64()))]
        return pa.record_batch([batch.column(0), batch.column(1), *cols],
                               ["doc_id", "levels", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.array(F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit(EVERYTHING)).alias("levels"), "text")
    return map_rows(rows, run, "doc_id long, levels array<string>, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, x array<double>")


def chi2_cdf(x: float, dof: float) -> float:
    """Series of the regularised lower incomplete gamma function, summed until a term no longer counts."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(q: float, dof: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, dof) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return high


def _consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def distance2(x: Column, mean: Column, inverse: Column) -> Column:
    d = [x[i] - mean[i] for i in range(P)]
    terms = [d[i] * d[j] * inverse[P * i + j] for i in range(P) for j in range(P)]
    return sum(terms[1:], terms[0])


def _moments() -> list[Column]:
    x = F.col("x")
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i]) for i in range(P)]).alias("s"),
            F.array(*[F.sum(x[i] * x[j]) for i in range(P) for j in range(P)]).alias("q")]


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse scatter and log-determinant of each group, from its sums: one small row per group."""
    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        mean, inverse, logdet = [], [], []
        for n, s, q in zip(*[batch.column(c).to_pylist() for c in ("n", "s", "q")]):
            m = np.array(s) / n
            cov = factor * (np.array(q).reshape(P, P) / n - np.outer(m, m)) + np.diag(np.square(FLOORS))
            mean.append(m)
            inverse.append(np.linalg.inv(cov).ravel())
            logdet.append(float(np.linalg.slogdet(cov)[1]))
        kind = pa.list_(pa.float64())
        return pa.record_batch([batch.column(0), pa.array(mean, kind), pa.array(inverse, kind), pa.array(logdet, pa.float64())],
                               ["grp", "mean", "inverse", "logdet"])

    return map_rows(moments.select("grp", "n", "s", "q"), solve, "grp string, mean array<double>, inverse array<double>, logdet double")


def robust_estimates(rows: DataFrame, *, share: float, max_steps: int, tol: float = 1e-3) -> DataFrame:
    """``grp, mean, inverse`` by concentration steps from coordinate-wise medians, then one reweighted step.

    Distances are cut at the group's ``share`` quantile (accuracy 1/10,000 of the rows, merged from partial sketches, so
    no group meets in one task). Steps go on until no group's log-determinant falls by more than ``tol``."""
    medians = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], 0.5, 10_000).alias(f"m{i}") for i in range(P)])
    medians = stored(medians, "mcd-medians")
    spread = rows.join(medians, "grp").groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i in range(P)])
    scale = [F.pow(F.col(f"d{i}") * 1.4826, 2) + FLOORS[i] ** 2 for i in range(P)]
    now = stored(spread.select("grp", F.array(*[F.col(f"m{i}") for i in range(P)]).alias("mean"),
                               F.array(*[(1 / scale[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse"),
                               F.lit(None).cast("double").alias("logdet")), "mcd-start")
    for _ in range(max_steps):
        far = rows.join(now, "grp").select("grp", "x", distance2(F.col("x"), F.col("mean"), F.col("inverse")).alias("d2"))
        cut = stored(far.groupBy("grp").agg(F.percentile_approx("d2", share, 10_000).alias("cut")).join(now, "grp"), "mcd-cut")
        near = rows.join(cut, "grp").where(distance2(F.col("x"), F.col("mean"), F.col("inverse")) <= F.col("cut"))
        new = stored(_estimates(near.groupBy("grp").agg(*_moments()), _consistency(share)), "mcd-step")
        falls = new.join(now.select("grp", F.col("logdet").alias("before")), "grp").agg(F.max(F.coalesce(F.col("before") - F.col("logdet"), F.lit(1e9)))).first()[0]
        now = new
        if falls is None or falls < tol:
            break
    inside = rows.join(now, "grp").where(distance2(F.col("x"), F.col("mean"), F.col("inverse")) <= chi2_quantile(0.975, P))
    return stored(_estimates(inside.groupBy("grp").agg(*_moments()), _consistency(0.975)), "mcd-final")


def quality_rules(docs: DataFrame, *, min_words: int = 50, max_repeat: int = 50, share: float = 0.75, quantile: float = 1 - 1e-6,
                  min_group: int = 30, max_steps: int = 8) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept`` of each row.

    Base rules fail a text of fewer than ``min_words`` words, or with more than ``max_repeat`` percent of its words in
    repeated windows of three. Estimates use the rows of a (language, source) group that pass them; null languages and
    sources form groups of their own. Rows of a group of fewer than ``min_group`` passing rows are measured by the estimate
    over all passing rows of their language, or over all passing rows if those are fewer too, however few there are. A passing
    row is kept if its squared distance, which is never null, is at most the chi-square ``quantile``.
    Null and empty texts have no words. Repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    rows = stored(statistics(docs), "quality-statistics").withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    passing = rows.where("not base_failed").select("levels", "x")
    members = stored(passing.groupBy("levels").agg(F.count(F.lit(1)).alias("m")).select("m", F.posexplode("levels").alias("level", "grp"),
                                                                                        F.col("levels")[0].alias("own")), "quality-groups")
    large = members.groupBy("grp").agg(F.sum("m").alias("m")).where((F.col("m") >= min_group) | (F.col("grp") == EVERYTHING)).select("grp")
    used = stored(members.join(large, "grp").groupBy("own").agg(F.min_by("grp", "level").alias("grp")), "quality-levels")
    samples = stored(passing.select(F.explode("levels").alias("grp"), "x").join(used.select("grp").distinct(), "grp"), "quality-samples")
    estimates = robust_estimates(samples, share=share, max_steps=max_steps)
    judged = rows.withColumn("own", F.col("levels")[0]).join(used.join(estimates, "grp").drop("grp"), "own", "left")
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), distance2(F.col("x"), F.col("mean"), F.col("inverse"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2",
                         (~F.col("base_failed") & (F.col("distance2") <= chi2_quantile(quantile, P))).alias("kept"))
