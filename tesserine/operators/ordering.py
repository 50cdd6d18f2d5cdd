"""Global ranks and cumulative sums that do not funnel a table through one task.

Rows are first aggregated to distinct values (ties and copies collapse there),
value ranges are cut at sampled quantiles, positions are accumulated inside each
range, and the totals of lower ranges are added from a table with one row per
range. Unit tables whose size is proven small use one plain window instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.session import UNIT_LIMIT, cut_lineage

_RANGES = 256


def value_positions(
    df: DataFrame,
    value: str,
    sums: dict[str, Column] | None = None,
    by: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Per distinct value: rows holding it (`n_eq`), rows below (`n_lt`), rows in all (`n_all`).

    For each entry of `sums` also the sum at this value (`name`), up to and
    including it (`cum_name`) and overall (`all_name`). `max_rows` is a bound the
    caller has proven for the whole table.
    """
    by = list(by)
    measures = {"n_eq": F.count("*"), **{k: F.sum(v) for k, v in (sums or {}).items()}}
    pre = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[e.alias(n) for n, e in measures.items()])
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        return _accumulate(pre, by, value, list(measures))
    pre = cut_lineage(pre)
    if pre.count() <= UNIT_LIMIT:
        return _accumulate(pre, by, value, list(measures))
    cuts = sorted(set(pre.approxQuantile(value, [i / _RANGES for i in range(1, _RANGES)], 0.25 / _RANGES)))
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    pre = pre.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(value))))
    inner = _accumulate(pre, [*by, "_range"], value, list(measures), totals=False)
    ranges = pre.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in measures])
    # One row per range and group: at most _RANGES rows in a window task.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = ranges.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_a_{n}") for n in measures],
    )
    joined = inner.join(offsets, [*by, "_range"])
    out = [*by, value, "n_eq", (F.col("_c_n_eq") + F.col("_o_n_eq") - F.col("n_eq")).alias("n_lt"), F.col("_a_n_eq").alias("n_all")]
    for n in measures:
        if n != "n_eq":
            out += [n, (F.col(f"_c_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}"), F.col(f"_a_{n}").alias(f"all_{n}")]
    return joined.select(*out)


def _accumulate(pre: DataFrame, by: list[str], value: str, names: list[str], totals: bool = True) -> DataFrame:
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    if not totals:
        return pre.select("*", *[F.sum(n).over(running).alias(f"_c_{n}") for n in names])
    out = [*by, value, "n_eq",
           (F.sum("n_eq").over(running) - F.col("n_eq")).alias("n_lt"), F.sum("n_eq").over(whole).alias("n_all")]
    for n in names:
        if n != "n_eq":
            out += [n, F.sum(n).over(running).alias(f"cum_{n}"), F.sum(n).over(whole).alias(f"all_{n}")]
    return pre.select(*out)


def with_rank(
    df: DataFrame,
    value: str,
    name: str,
    method: str = "min",
    descending: bool = False,
    by: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Append a rank of `value`; ties share the smallest (`min`) or the mean (`average`) position."""
    by = list(by)
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        over = Window.partitionBy(*by)
        first = F.rank().over(over.orderBy(F.col(value).desc() if descending else F.col(value).asc()))
        if method == "min":
            return df.withColumn(name, first.cast("bigint"))
        ties = F.count("*").over(Window.partitionBy(*by, value))
        return df.withColumn(name, first + (ties - 1) / 2.0)
    df = cut_lineage(df)  # joined back on the value itself: a fresh sum could differ in its last bit and lose the row
    pos = value_positions(df, value, by=by)
    below = F.col("n_all") - F.col("n_lt") - F.col("n_eq") if descending else F.col("n_lt")
    rank = (below + 1).cast("bigint") if method == "min" else below + (F.col("n_eq") + 1) / 2.0
    return df.join(pos.select(*by, value, rank.alias(name)), [*by, value], "left")


def row_ids(df: DataFrame, order: Sequence[str], name: str, max_rows: int | None = None) -> DataFrame:
    """Dense 0-based id in a total order.

    Large tables are range-partitioned once and checkpointed, so the partition a
    row belongs to is fixed before its offset is looked up.
    """
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    parts = max(_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ordered.withColumn("_in", inner).join(offsets, "_part")
        .withColumn(name, (F.col("_in") + F.col("_offset") - 1).cast("bigint")).drop("_part", "_in", "_offset")
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group.

    The built-in `percentile` keeps every distinct value of a group in one
    buffer; beyond a proven small size the ranks come from `value_positions`.
    """
    by = list(by)
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        grid = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*by).agg(grid.alias("_q")).select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    pos = value_positions(df, value, by=by)
    at = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n_all") - 1)
        at += [F.max(F.when(F.col("n_lt") <= F.floor(h), F.col(value))).alias(f"_lo{i}"),
               F.max(F.when(F.col("n_lt") <= F.ceil(h), F.col(value))).alias(f"_hi{i}"),
               F.max(h - F.floor(h)).alias(f"_f{i}")]
    found = pos.groupBy(*by).agg(*at)
    return found.select(*by, *[
        (F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n) for i, n in enumerate(names)])


def weighted_quantiles(
    df: DataFrame, value: str, weight: str, probs: Sequence[float], names: Sequence[str],
    by: Sequence[str] = (), max_rows: int | None = None,
) -> DataFrame:
    """First value whose cumulative weight reaches the wanted share, one row per group."""
    pos = value_positions(df, value, {"w": F.col(weight)}, by, max_rows)
    return pos.groupBy(*by).agg(*[
        F.min(F.when(F.col("cum_w") >= p * F.col("all_w"), F.col(value))).alias(n) for p, n in zip(probs, names)])


def row_ids_within(df: DataFrame, by: str, order: Sequence[str], name: str, max_rows: int | None = None) -> DataFrame:
    """Dense 0-based id inside each value of `by`."""
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("bigint"))
    ids = cut_lineage(row_ids(df, [by, *order], "_g"))
    start = ids.groupBy(by).agg(F.min("_g").alias("_s"))
    return ids.join(start, by).withColumn(name, F.col("_g") - F.col("_s")).drop("_g", "_s")


def suffix_min(pos: DataFrame, order: str, value: str, name: str, max_rows: int | None = None) -> DataFrame:
    """Smallest `value` at or above each position of a table with distinct `order`."""
    ahead = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    if max_rows is not None and max_rows <= UNIT_LIMIT:
        return pos.withColumn(name, F.min(value).over(ahead))
    pos = cut_lineage(pos)
    if pos.count() <= UNIT_LIMIT:
        return pos.withColumn(name, F.min(value).over(ahead))
    cuts = sorted(set(pos.approxQuantile(order, [i / _RANGES for i in range(1, _RANGES)], 0.25 / _RANGES)))
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    pos = pos.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(order))))
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # at most _RANGES rows
    tails = pos.groupBy("_range").agg(F.min(value).alias("_m")).select("_range", F.min("_m").over(later).alias("_later"))
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return (pos.withColumn("_in", F.min(value).over(inner)).join(tails, "_range")
            .withColumn(name, F.least("_in", "_later")).drop("_in", "_later", "_range"))
