"""Bootstrap and jackknife as joins on a table of draws.

A draw is a multiset of units; it is stored as (draw, unit, times). Indices come
from digests, so any executor can rebuild any draw alone, or from a replayed
generator stream where a fixed published sequence has to be reproduced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import hash_uniform
from tesserine.operators.ordering import row_ids

_BLOCK = 50


def digest_draws(units: DataFrame, key: str, draws: int, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """(draw, key, times): n picks with replacement per draw."""
    indexed = row_ids(units.select(key).distinct(), [key], "_i", max_rows)
    n = indexed.agg(F.count("*")).scalar()
    slots = indexed.select(F.col("_i").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    pick = F.floor(hash_uniform(F.lit(seed), "draw", "_slot") * n).cast("bigint")
    return slots.select("draw", pick.alias("_i")).groupBy("draw", "_i").agg(F.count("*").alias("times")).join(indexed, "_i").select("draw", key, "times")


def block_draws(units: DataFrame, key: str, block: str, draws: int, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """Whole blocks drawn with replacement; every unit of a picked block comes along."""
    picked = digest_draws(units.select(block).distinct(), block, draws, seed, max_rows)
    return picked.join(units.select(key, block), block).select("draw", key, "times")


def replayed_draws(spark, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, position, times) of numpy's default generator, one stream across all draws.

    Each task replays the stream up to its own block of draws; a draw costs n
    integers, so replaying is cheap next to a driver-side table.
    """
    def replay(batches):
        for pdf in batches:
            for b in pdf["id"]:
                rng = np.random.default_rng(seed)
                frames = []
                for d in range(min((int(b) + 1) * _BLOCK, draws)):
                    picks = rng.integers(0, n, n)
                    if d >= int(b) * _BLOCK:
                        position, times = np.unique(picks, return_counts=True)
                        frames.append(pd.DataFrame({"draw": d, "position": position, "times": times}))
                yield pd.concat(frames)

    blocks = -(-draws // _BLOCK)
    return spark.range(0, blocks, 1, blocks).mapInPandas(replay, "draw bigint, position bigint, times bigint")


def percentile_interval(df: DataFrame, value: str, by: list[str] | None = None, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile bounds over draws (a few thousand values per group, by construction of the draw count)."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n_valid"), F.count_if(F.col(value).isNull()).alias("n_undefined"), q[0].alias("ci_low"), q[1].alias("ci_high"))


def weighted_corr(a: Column, b: Column, w: Column) -> Column:
    """Pearson correlation with integer multiplicities, from plain sums; NULL when a side is constant."""
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    va = F.sum(w * a * a) - sa * sa / n
    vb = F.sum(w * b * b) - sb * sb / n
    spread = F.when((va > 1e-12) & (vb > 1e-12), F.sqrt(va * vb))
    return (F.sum(w * a * b) - sa * sb / n) / spread


def effective_size(draws: DataFrame) -> DataFrame:
    """Distinct units and Kish effective sample size per draw."""
    return draws.groupBy("draw").agg(
        F.count("*").alias("n_distinct"), (F.sum("times") * F.sum("times") / F.sum(F.col("times") * F.col("times"))).alias("ess"))
