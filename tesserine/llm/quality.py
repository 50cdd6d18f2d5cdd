"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Base counts and a vector of transformed statistics are taken from every whole text. Per language and source, concentration steps
look for the three quarters of rows whose covariance has the least determinant: each step measures every row's Mahalanobis
distance, adds up products per distance bin, and takes the bins up to that share as the next estimate. A step is one
aggregation over all rows into at most `BINS` rows per group, so a source that owns a third of the rows is summed map-side. A
last, reweighted estimate judges: rows beyond `CUTOFF` are rejected.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.llm.common import query, saved, small_batches, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Statistics of the vector, and the standard deviation whose square is added to each variance: shares are compared on the arcsine scale.
#: Digits alone, or duplicate lines alone, can pass `CUTOFF` (from 30 % on in a group that has none); repeats have a base rule of their own.
STATISTICS = ("upper", "marks", "digits", "repeats", "duplicates", "log_word")
FLOOR = (0.06, 0.03, 0.12, 0.15, 0.12, 0.15)
P = len(STATISTICS)
#: Characters of ordinary text that a short text's shares are mixed with, and its shares of capitals and marks.
PRIOR, USUAL = 60, 0.03
#: Lines without a copy that a text's lines are mixed with: one repeated line of five says little.
PRIOR_LINES = 10
#: Share of rows a concentration step keeps, steps, share of the reweighted step, and the squared distance
#: that rejects: one normal row in a thousand.
KEPT, STEPS, REWEIGHTED, CUTOFF = 0.75, 3, 0.975, 22.46
#: Rows that a group of its own needs; smaller groups are judged with their language, and those of small languages together.
LEAST_ROWS = 60
#: Distance bins: squared distances on a log2 scale in sixteenths, from 2^-10 to 2^20.
PER_OCTAVE, LOWEST, BINS = 16, -160, 480
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


@functools.cache
def _kinds() -> np.ndarray:
    """Class of every code point: 0 other, 1 upper-case letter, 2 other letter, 3 digit, 4 white space."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        kinds[c] = 1 if k in ("Lu", "Lt") else 2 if k[0] == "L" or k[0] == "M" else 3 if k[0] == "N" else 4 if k[0] == "Z" or chr(c) in SPACES else 0
    return kinds


def _repeated(words: list[bytes], n: int) -> int:
    """Words that lie in a window of n words found twice or more in the text."""
    if len(words) <= n:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    m = len(codes) - n + 1
    key, span = codes[:m], len(known)
    for k in range(1, n):  # exact: a key is renumbered before it could overflow
        if span > (1 << 62) // len(known):
            distinct, key = np.unique(key, return_inverse=True)
            span = len(distinct)
        key = key * len(known) + codes[k: k + m]
        span *= len(known)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(times[inverse] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector (None without words)."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    duplicate = 0
    for line in lines:
        if line in seen:
            duplicate += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeats = _repeated(words, 5)
    if not n:
        return n, chars, symbols, duplicate, repeats, None
    upper, lower, digits, _ = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=5)[1:5]
    marks = max(chars - upper - lower - digits, 0)
    usual = PRIOR * USUAL
    shares = ((upper + usual) / (upper + lower + PRIOR), (marks + usual) / (chars + PRIOR), digits / (chars + PRIOR), repeats / n, duplicate / (len(lines) + PRIOR_LINES))
    return n, chars, symbols, duplicate, repeats, [*(math.asin(math.sqrt(min(1.0, s))) for s in shares), math.log(chars / n)]


def _measure_all(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t or "") for t in text], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])


def measured(text: Column) -> Column:
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
    return F.pandas_udf(_measure_all, fields)(text)


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def _chi2_below(x: float, df: int) -> float:
    """Distribution function of chi-square with an even number of degrees."""
    term = total = math.exp(-x / 2)
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def _consistency(share: float) -> tuple[float, float]:
    """Squared distance below which `share` of normal rows lies, and the factor that undoes cutting the rest off."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_below(mid, P) < share else (lo, mid)
    return lo, share / _chi2_below(lo, P + 2)


def _key(lang: Column, source: Column) -> tuple[Column, Column]:
    return F.coalesce(lang.cast("string"), F.lit("\x00")), F.coalesce(source.cast("string"), F.lit("\x00"))


def _strata(rows: DataFrame) -> DataFrame:
    """(lang, source) -> stratum. Groups with too few rows share their language's stratum, small languages one for all."""
    counts = rows.where("ok").groupBy("l", "s").agg(F.count("*").alias("n"))
    own = F.col("n") >= LEAST_ROWS
    left = F.sum(F.when(own, 0).otherwise(F.col("n"))).over(Window.partitionBy("l"))
    name = F.when(own, F.concat_ws("\x01", F.lit("group"), "l", "s")).when(left >= LEAST_ROWS, F.concat_ws("\x01", F.lit("language"), "l"))
    return counts.select(F.col("l"), F.col("s"), F.coalesce(name, F.lit("rest")).alias("stratum"))


def _precision(n: pd.Series, sums: pd.Series, products: pd.Series, center: pd.Series, factor: pd.Series) -> pd.Series:
    """Mean and inverse covariance, one after another, from sums of rows less `center`; variances have a floor."""
    out = []
    for rows, s, q, c, f in zip(n, sums, products, center, factor, strict=True):
        mean = np.asarray(s) / rows
        cov = np.empty((P, P))
        for (i, j), v in zip(_PAIRS, q, strict=True):
            cov[i, j] = cov[j, i] = v / rows - mean[i] * mean[j]
        cov = cov * f + np.diag(np.square(FLOOR))
        out.append([*(mean + np.asarray(c)[:P]), *np.linalg.inv(cov).ravel()])
    return pd.Series(out)


def _distance(x: Column, est: Column) -> Column:
    """Squared Mahalanobis distance, spelled out so that it compiles."""
    y = [x[i] - est[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + y[i] * y[j] * est[P + i * P + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each coordinate; values are rounded, so a group's counts stay few."""
    quartiles = [F.expr(f"percentile(round(x[{i}], 3), array(0.25, 0.5, 0.75))").alias(f"q{i}") for i in range(P)]
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]
    flat = [F.col(f"q{i}")[1] for i in range(P)] + [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    return rows.groupBy("stratum").agg(*quartiles).select("stratum", F.array(*flat).alias("est"))


def _step(rows: DataFrame, est: DataFrame, share: float | None, factor: float, within: float | None = None) -> DataFrame:
    """The next estimate: of the `share` of rows nearest to `est`, or of the rows `within` a squared distance."""
    near = rows.join(est, "stratum").withColumn("d", _distance(F.col("x"), F.col("est")))
    level = F.floor(F.log2(F.col("d") + 1e-9) * PER_OCTAVE) - LOWEST
    if within is not None:
        near = near.where(F.col("d") <= within)
    near = near.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), level)).cast("int") if within is None else F.lit(0))
    y = [F.col("x")[i] - F.col("est")[i] for i in range(P)]
    sums = near.groupBy("stratum", "bin").agg(
        F.count("*").alias("n"), F.first("est").alias("center"), *[F.sum(y[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(y[i] * y[j]).alias(f"p{i}_{j}") for i, j in _PAIRS])
    if share is not None:
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("ahead", ahead).withColumn("all", F.sum("n").over(Window.partitionBy("stratum"))).where(
            F.col("ahead") < F.ceil(F.col("all") * share))
    total = sums.groupBy("stratum").agg(
        F.sum("n").alias("n"), F.first("center").alias("center"), F.array(*[F.sum(f"s{i}") for i in range(P)]).alias("s"),
        F.array(*[F.sum(f"p{i}_{j}") for i, j in _PAIRS]).alias("p"))
    return saved(total.select("stratum", F.pandas_udf(_precision, "array<double>")("n", "s", "p", "center", F.lit(factor)).alias("est")), "estimates")


def estimates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
              id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, judges): the measured rows (id, m, l, s), and (l, s) -> est, the mean and inverse covariance that judge a group.

    Null text counts as empty; null language and source are values of their own. Rows that fail the base rules, and groups in
    whose stratum no row passes them, have no estimate. Other columns are not read. An empty table gives empty results.
    """
    lang, source = _key(F.col(lang_col), F.col(source_col))
    rows = small_batches(docs).select(F.col(id_col).alias("id"), lang.alias("l"), source.alias("s"), measured(F.col(text_col)).alias("m"))
    rows = saved(rows.withColumn("ok", ~_base_failed(F.col("m"))), "measured")
    strata = saved(_strata(rows), "strata")
    x = saved(rows.where("ok").join(strata, ["l", "s"]).select("stratum", F.col("m.x").alias("x")), "vectors")
    est = saved(_start(x), "estimates")
    for _ in range(STEPS):
        est = _step(x, est, KEPT, _consistency(KEPT)[1])
    limit, factor = _consistency(REWEIGHTED)
    est = _step(x, est, None, factor, within=limit)
    return rows, saved(strata.join(est, "stratum").select("l", "s", "est"), "judges")


def _kept(m: Column, est: Column) -> Column:
    return ~_base_failed(m) & F.coalesce(_distance(m["x"], est) <= CUTOFF, F.lit(True))


def quality(docs: DataFrame, **names: str) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, kept, distance (squared; null where nothing judges)."""
    rows, judges = estimates(docs, **names)
    judged = rows.join(judges, ["l", "s"], "left")
    m = F.col("m")
    return judged.select("id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", _base_failed(m).alias("base_failed"),
                         _kept(m, F.col("est")).alias("kept"), F.when(~_base_failed(m), _distance(m["x"], F.col("est"))).alias("distance"))


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **names: str) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns. Texts are measured again instead of being moved to their verdicts."""
    _, judges = estimates(docs, text_col, lang_col, source_col, **names)
    lang, source = _key(F.col(lang_col), F.col(source_col))
    marked = docs.withColumns({"__m": measured(F.col(text_col)), "__l": lang, "__s": source})
    judges = judges.select(F.col("l").alias("__l"), F.col("s").alias("__s"), F.col("est").alias("__est"))
    return marked.join(judges, ["__l", "__s"], "left").where(_kept(F.col("__m"), F.col("__est"))).select(*docs.columns)


@query("op1_robust_outliers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
