"""Near-duplicates by b-bit MinHash with exact confirmation.

A document's set holds its distinct word shingles. Every set gets minima under many permutations; runs of minima make band keys,
and the low bits of all minima are packed as the signature. Equal sets collapse first. Sets that share a band key are candidates:
each is held against the bucket's least set (its pivot) on full shingle sets, which also gives its difference from the pivot.
Buckets whose members are then still in several components are opened: pairs of members from different components whose packed
signatures agree in enough bits, corrected for chance collisions, are compared exactly through their differences from the shared
pivot. So members already connected are never paired, and large buckets are dealt out in cells of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import components, query, saved, sent, small_batches, table

#: Permutations, and the greatest probability with which a pair at the threshold may share no band.
HASHES, MISSED = 280, 1e-6
#: Bits kept of a minimum, and standard errors below the threshold at which an estimate still leads to an exact comparison.
BITS, ERRORS = 2, 5.0
#: Members of a block when a large bucket is opened.
BLOCK = 256
REMEMBERED = 150_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_draw = np.random.default_rng(20_240_601)
_MULTIPLY = _draw.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    codes = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(codes))
    m = len(codes) - span + 1
    total = np.full(m, span, np.uint64)
    for k in range(span):
        total = _mix(total * _ODD[0] + codes[k: k + m])
    return np.unique(total)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (_MULTIPLY[:, None] * low[None, at: at + 2048] + _ADD[:, None]).min(axis=1))
    return best


def band_rows(percent: int) -> int:
    """Minima of a band: as many as keep the chance of a missed pair at the threshold below `MISSED` (7 of them at 85, 6 at 80)."""
    t = percent / 100
    return max((r for r in range(1, 33) if (1 - t ** r) ** (HASHES // r) < MISSED), default=1)


def band_keys(best: np.ndarray, rows: int) -> np.ndarray:
    bands = HASHES // rows
    minima_ = best[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return _mix((minima_ * _ODD[1: 1 + rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[40]).view(np.int64)


def packed_bits(best: np.ndarray) -> np.ndarray:
    """The low two bits of every minimum, 32 minima to a long; the rest of the last long is zero."""
    low = np.zeros(-(-HASHES // 32) * 32, np.uint64)
    low[:HASHES] = best & np.uint32(3)
    return (low.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _list(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values]).astype(np.int64, copy=False)))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                best = [minima(s) if len(s) else None for s in sets]
                none = np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    _list([none if b is None else band_keys(b, rows) for b in best]), _list([none if b is None else packed_bits(b) for b in best])],
                    ["id", "n", "fp", "bands", "bits"])
        _known.clear()  # the worker goes on to other stages

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        sign, "id long, n long, fp string, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t, width) for t in batch.column(0).slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), _list([s.view(np.int64) for s in sets])], ["fp", "set"])
        _known.clear()

    return docs.select("text").mapInArrow(collect, "fp string, set array<long>")


def _linked(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return shared * 100 >= (n + m - shared) * percent


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: agreeing two-bit minima, less the quarter that agrees by chance."""
    differ = F.lit(0)
    for i in range(-(-HASHES // 32)):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0 ** -BITS
    return ((1 - differ / float(HASHES)) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their full sets; component_id is the least id that links
    lead to. Null text counts as empty: no set, linked with nothing. A null id never is a component_id while another id is in the
    component; rows that repeat an id are one document, so all of them are kept or none. Other columns are not read.
    """
    signed = saved(signatures(small_batches(docs), id_col, text_col, width, band_rows(percent)), "signatures")
    classes = signed.where("n > 0").groupBy("fp", "n").agg(
        F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # candidates: each member of a bucket with the bucket's least node
    keyed = classes.select("node", F.explode("bands").alias("key")).repartition("key")
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    pairs = saved(keyed.join(pivots, "key").where(F.col("node") != F.col("pivot")).select("pivot", "node").distinct(), "candidates")
    wanted = saved(pairs.select("node").union(pairs.select("pivot")).distinct().join(classes.select("node", "least_id"), "node"), "wanted")
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        sent(wanted.select("least_id").distinct()), F.col("id").eqNullSafe(F.col("least_id")), "left_semi")
    found = _sets(some, width).groupBy("fp").agg(F.first("set").alias("set"))
    sets = saved(found.join(classes.select("fp", "node", "n").join(wanted.select("node"), "node"), "fp").select("node", "n", "set"), "sets")
    held = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("set").alias("pset")), "pivot")
    held = held.select("pivot", "node", "n", "pn", F.array_except("pset", "set").alias("less"), F.array_except("set", "pset").alias("more"))
    held = saved(held.withColumn("linked", _linked(F.col("pn") - F.size("less"), F.col("pn"), F.col("n"), percent)), "held")
    star = held.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    labels = components(star)
    # buckets that hold several components: pairs across components, by their differences from the pivot
    nothing = F.array().cast("array<long>")
    own = held.groupBy("pivot").agg(F.first("pn").alias("n")).select("pivot", F.col("pivot").alias("node"), "n", F.col("n").alias("pn"), nothing.alias("less"), nothing.alias("more"))
    members = held.drop("linked").union(own).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shares = members.groupBy("pivot", "label").agg(F.count("*").alias("c"))
    open_ = shares.groupBy("pivot").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.count("*").alias("labels"))
    open_ = saved(open_.where("labels > 1 and size > 2").select("pivot", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    members = members.join(open_, "pivot").join(classes.select("node", "bits"), "node").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    members = saved(members, "members")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.select("pivot", F.col("block").alias("i"), every.alias("j"), *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "label", "less", "more", "bits")])
    right = members.where(F.col("label") != F.col("main")).select(
        "pivot", every.alias("i"), F.col("block").alias("j"), "main", "pn", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "label", "less", "more", "bits")])
    t = percent / 100
    error = ((t + (1 - t) / 4) * (1 - t) * 0.75 / HASHES) ** 0.5 / 0.75
    shared = F.col("pn") - F.size("a_less") - F.size("b_less") + F.size(F.array_intersect("a_less", "b_less")) + F.size(F.array_intersect("a_more", "b_more"))
    near = left.join(right, (left.pivot == right.pivot) & (left.i == right.i) & (left.j == right.j) & (F.col("a_label") != F.col("b_label"))
                     & ((F.col("a_label") == F.col("main")) | (F.col("a_node") < F.col("b_node")))
                     & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
                     & (estimate(F.col("a_bits"), F.col("b_bits")) >= t - ERRORS * error)
                     & _linked(shared, F.col("a_n"), F.col("b_n"), percent))
    crossed = saved(near.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "crossed")
    if not crossed.isEmpty():
        joined = components(crossed).withColumnRenamed("label", "over").withColumnRenamed("node", "label")
        labels = labels.union(crossed.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = saved(labels.join(joined, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")
    named = classes.select("fp", "node", "least_id", "copies").join(labels, "node", "left").where(F.col("label").isNotNull() | (F.col("copies") > 1))
    named = named.withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = saved(named.join(least, "label").select("fp", "component_id"), "components")
    return signed.select("id", "n", "fp").join(named, "fp", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of `docs` that are kept. Rows without an id stay: nothing names them."""
    gone = near_duplicates(docs, id_col=id_col, **names).where(~F.col("kept") & F.col("id").isNotNull())
    gone = saved(gone.select(F.col("id").alias("__id")).distinct(), "gone")
    return docs.join(sent(gone), F.col(id_col) == F.col("__id"), "left_anti")


@query("op8_bbit_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
