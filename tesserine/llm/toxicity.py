"""Classifier chain for toxicity categories.

Linear models predict the categories one after another. The model of a later category also sees the probabilities of the earlier
ones; in training these are out-of-fold predictions, so a later model meets earlier probabilities as good as it will meet when it
scores new documents. Models are fitted on at most `most_rows` labelled documents, taken by a digest of their id; every document
is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, saved, sent, small_batches, table

_WORDS = re.compile(r"[^\W\d_]+")
#: Labelled documents that a fit may use, folds of the out-of-fold predictions, words of a model, documents a word must be in,
#: standard errors by which a word's share of positives must differ from the usual share, and the ridge penalty.
MOST_ROWS, FOLDS, MOST_WORDS, LEAST_DOCUMENTS, LEAST_Z, PENALTY = 8_000, 3, 100, 5, 4.0, 0.003
#: Lengths of word beginnings that count as features of their own.
PREFIXES = (4, 5, 6)
FITTED = "step int, word string, weight double"


def features(text: str, prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """The distinct words of the whole text in small letters, and the beginnings of longer words, which carry a final hyphen."""
    words = set(_WORDS.findall(text.lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in prefixes))


def presence(texts: list[str], words: list[str]) -> np.ndarray:
    """One row per text, one column per feature: 1 where the text has it."""
    at = {w: k for k, w in enumerate(words)}
    known, prefixes = at.keys(), tuple({len(w) - 1 for w in words if w.endswith("-")})
    x = np.zeros((len(texts), len(words)))
    for row, text in zip(x, texts, strict=True):
        for w in known & features(text, prefixes):
            row[at[w]] = 1.0
    return x


@dataclass
class Chain:
    """Words of the chain, and per category the weights: intercept, words, then one for each earlier category."""

    words: list[str]
    weights: list[np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities, one row per text and one column per category."""
        return chained(presence(texts, self.words), self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def chained(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    done = np.zeros((len(x), 0))
    for w in weights:
        done = np.column_stack([done, _sigmoid(w[0] + x @ w[1: 1 + x.shape[1]] + done @ w[1 + x.shape[1]:])])
    return done


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept is hardly penalised. One class alone gives a constant."""
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag(np.r_[1e-3, np.full(x.shape[1], penalty)])
    w = np.zeros(design.shape[1])
    for _ in range(25):
        p = _sigmoid(design @ w)
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def telling_words(texts: list[str], labels: np.ndarray) -> list[str]:
    """Features whose documents are positive far more or less often than usual, by any category; of a word and its beginnings
    with the same counts only the first found."""
    seen: Counter[str] = Counter()
    positive: list[Counter[str]] = [Counter() for _ in labels.T]
    for text, row in zip(texts, labels, strict=True):
        found = features(text)
        seen.update(found)
        for counter, value in zip(positive, row, strict=True):
            if value:
                counter.update(found)
    kept = [w for w, n in seen.items() if n >= LEAST_DOCUMENTS]
    chosen: dict[str, None] = {}
    for counter, share in zip(positive, labels.mean(axis=0), strict=True):
        if share in (0.0, 1.0):
            continue
        z = {w: (counter[w] - seen[w] * share) / (seen[w] * share * (1 - share)) ** 0.5 for w in kept}
        alike: set[tuple[str, int, int]] = set()
        taken = 0
        for w in sorted((w for w in kept if abs(z[w]) >= LEAST_Z), key=lambda w: (-abs(z[w]), -len(w), w)):
            key = (w[:4], seen[w], counter[w])
            if key not in alike and taken < MOST_WORDS:
                alike.add(key)
                chosen[w] = None
                taken += 1
    return list(chosen)


def fit(texts: list[str], labels: np.ndarray, folds: np.ndarray) -> Chain:
    words = telling_words(texts, labels)
    x = presence(texts, words)
    weights, earlier = [], np.zeros((len(x), 0))
    for y in labels.T:
        design = np.column_stack([x, earlier])
        weights.append(logistic(design, y))
        out = np.full(len(y), y.mean())
        for k in range(FOLDS):
            train, held = folds != k, folds == k
            if held.any() and train.any():
                w = logistic(design[train], y[train])
                out[held] = _sigmoid(w[0] + design[held] @ w[1:])
        earlier = np.column_stack([earlier, out])
    return Chain(words, weights)


def fit_chain(labelled: DataFrame, categories: list[str], text_col: str = "text", most_rows: int = MOST_ROWS, order: Column | None = None) -> Chain:
    """Fit on at most `most_rows` rows, those first by `order` (by default a digest of the text).

    Rows whose label of any category is null are left out; null text counts as empty; equal texts share a fold. Without labelled
    rows every probability is 0.5, see `scored`.
    """
    rows = labelled.select(F.coalesce(text_col, F.lit("")).alias("text"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)],
                           (order if order is not None else F.xxhash64(text_col)).alias("o")).dropna(subset=[f"y{k}" for k in range(len(categories))])
    rows = rows.orderBy("o", F.xxhash64("text")).limit(most_rows).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(FOLDS)).cast("int"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        y = group[[f"y{k}" for k in range(len(categories))]].to_numpy(float)
        chain = fit(group["text"].tolist(), y, group["fold"].to_numpy())
        names = ["", *chain.words]
        return pd.DataFrame([(k, names[i] if i < len(names) else f" {i - len(names)}", float(v)) for k, w in enumerate(chain.weights) for i, v in enumerate(w)],
                            columns=["step", "word", "weight"])

    # a bounded sample, so one group; the fitted table has at most MOST_WORDS rows per category and category
    table_ = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, FITTED).toPandas()
    if table_.empty:
        return Chain([], [np.zeros(1 + k) for k in range(len(categories))])
    weights = [g["weight"].to_numpy() for _, g in table_.groupby("step", sort=True)]
    words = [w for w in table_[table_["step"] == 0]["word"] if w and not w.startswith(" ")]
    return Chain(words, weights)


def scored(docs: DataFrame, chain: Chain, categories: list[str], thresholds: list[float], text_col: str = "text") -> DataFrame:
    """`docs` with p_<category> and <category> (probability above its threshold) for every category.

    Null text counts as empty. A chain fitted without rows gives 0.5 everywhere, which is above no threshold of one half or more. Rows are
    independent, so null ids, repeated rows and empty tables need no care; columns of the same names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(text: pd.Series) -> pd.DataFrame:
        p = shared.value.score([t or "" for t in text])
        return pd.DataFrame(p, columns=[f"p_{c}" for c in categories])

    p = F.pandas_udf(score, ", ".join(f"`p_{c}` double" for c in categories))(F.col(text_col))
    out = small_batches(docs).withColumn("__p", p)
    for c, threshold in zip(categories, thresholds, strict=True):
        out = out.withColumn(f"p_{c}", F.col("__p")[f"p_{c}"]).withColumn(c, F.col("__p")[f"p_{c}"] > threshold)
    return out.drop("__p")


CATEGORIES = ["toxic", "toxic_junk", "toxic_prose"]
#: One toxic word must be enough in a corpus where few documents are toxic, so the first category asks for little.
THRESHOLDS = [0.03, 0.5, 0.5]


@query("op6_toxicity_chain")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    labels = labels.dropna().dropDuplicates(["doc_id"]).withColumn("o", F.xxhash64("doc_id"))
    some = saved(labels.orderBy("o", "doc_id").limit(MOST_ROWS), "labels")
    both = (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_junk"), (F.col("toxic") * F.col("quality")).alias("toxic_prose")
    labelled = docs.join(sent(some), "doc_id").select("text", "o", "toxic", *both)
    chain = fit_chain(saved(labelled, "labelled"), CATEGORIES, order=F.col("o"))
    return scored(docs, chain, CATEGORIES, THRESHOLDS).drop("text")
