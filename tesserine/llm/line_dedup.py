"""Lines found in many documents, dropped from all of them by probing a sharded minimal perfect hash.

Tasks read whole texts in blocks and keep 128-bit hashes of their lines. The documents of every distinct line are counted; each shard of
the lines becomes a minimal perfect hash whose slots index two compact arrays, fingerprints and counts. A block sends each shard the
packed hashes that fall to it, once each, and gets back which of them are found too often: lines are never joined to lines, and a very
common line is one probe of a block like any other. All lines of the corpus are keys, so a probe of one of them always meets its own
count; the fingerprint only turns lines away that were never counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import halves, query, saved, sent, small_batches, table

#: Lines of a block and probes of a shard, at most (a text with more lines is a block of its own).
BLOCK_LINES, SHARD_PROBES = 200_000, 250_000
#: Bits of a level of the hash for each key that reaches it.
ROOM = 2
WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A to Z in small letters."""
    return line.strip(WHITE).translate(_LOWER)


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 * (_A + np.uint64(2 * level)) + h2 * (_B + np.uint64(2 * level))
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


class LineIndex:
    """A minimal perfect hash over (h1, h2) with a fingerprint and a count in every slot.

    Level by level, keys that are alone at their place set its bit and the others go on to the next, smaller level. A key's slot
    is the number of bits set before its own, so n keys fill n slots.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> LineIndex:
        """Of distinct keys; counts take the fewest bytes that hold the largest."""
        left, sizes, bits = np.arange(len(h1)), [], []
        while len(left):
            words = -(-ROOM * len(left) // 64)
            place = (_mix(h1[left], h2[left], len(sizes)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            sizes.append(words)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        index = cls(np.array(sizes, np.int64), np.concatenate([np.empty(0, "<u8"), *bits]), np.zeros(len(h1), np.uint32),
                    np.zeros(len(h1), np.min_scalar_type(int(counts.max(initial=0)))))
        slots = index._slots(h1, h2)
        index.prints[slots], index.counts[slots] = index._print(h1, h2), counts
        return index

    @staticmethod
    def _print(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return (_mix(h2, h1, 97) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of every key; -1, or that of another key, where it is none."""
        slots, todo, first = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, words in enumerate(self.sizes.tolist()):
            place = (_mix(h1[todo], h2[todo], level) % np.uint64(64 * words)).astype(np.int64)
            word, bit = first + (place >> 6), (place & 63).astype(np.uint64)
            here = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[todo[here]] = (self.before[word] + below)[here]
            todo, first = todo[~here], first + words
        return slots

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How often each key was counted; 0 for lines whose fingerprint differs."""
        slots = self._slots(h1, h2)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == self._print(h1[known], h2[known])
        out = np.zeros(len(h1), np.int64)
        out[known] = self.counts[slots[known]]
        return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


class _Block:
    """Distinct texts of some rows, their lines' keys by number, and in how many rows each key is found."""

    def __init__(self) -> None:
        self.texts: dict[tuple[int, int], int] = {}
        self.times: list[int] = []
        self.hashes: list[bytes] = []
        self.sizes: list[int] = []

    def add(self, key: tuple[int, int], text: str, least: int) -> None:
        if (at := self.texts.get(key)) is not None:
            self.times[at] += 1
            return
        self.texts[key] = len(self.times)
        self.times.append(1)
        lines = [line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
        long = (lambda k: len(k) > 0) if least <= 1 else (lambda k: len(k.decode("utf-8", "replace")) >= least)
        self.hashes += [xxhash.xxh3_128_digest(k) if long(k) else b"" for k in lines]
        self.sizes.append(len(lines))

    def row(self, number: int) -> pa.RecordBatch:
        held = np.array([len(h) > 0 for h in self.hashes], bool)
        pairs = np.frombuffer(b"".join(self.hashes), "<i8").reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        ranked = pairs[order]
        new = np.ones(len(ranked), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        at = np.full(len(held), -1, np.int64)
        inner = np.empty(len(ranked), np.int64)
        inner[order] = np.cumsum(new) - 1
        at[held] = inner
        keys = ranked[new]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[held]
        both = np.unique(owner * max(len(keys), 1) + inner)
        docs = np.bincount(both % max(len(keys), 1), weights=np.array(self.times)[both // max(len(keys), 1)], minlength=len(keys)).astype(np.int64)
        texts = np.array(list(self.texts), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(_lists([x], pa.int64()) for x in (keys[:, 0], keys[:, 1], docs, texts[:, 0], texts[:, 1])),
             *(_lists([x], pa.int32()) for x in (np.array(self.sizes, np.int32), at.astype(np.int32)))],
            names=["block", "h1", "h2", "docs", "k1", "k2", "sizes", "at"])


_BLOCKS = "block long, h1 array<long>, h2 array<long>, docs array<long>, k1 array<long>, k2 array<long>, sizes array<int>, at array<int>"


def line_blocks(docs: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    """Blocks of rows as written: the numbers of blocks stay what they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                block.add((k1[i], k2[i]), text.as_py(), least_chars)
                if len(block.hashes) >= BLOCK_LINES:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.times:
            yield block.row(number)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*halves(F.md5(text.cast("binary"))), text.alias("text"))
    return saved(small_batches(rows).mapInArrow(pack, _BLOCKS), "line-blocks")


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def line_index(blocks: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its minimal perfect hash with fingerprints and counts."""
    each = blocks.select(F.inline(F.arrays_zip("h1", "h2", "docs")))
    counted = each.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        h1, h2, n = (part.column(c).to_numpy() for c in ("h1", "h2", "docs"))
        index = LineIndex.build(_unsigned(h1), _unsigned(h2), n)
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([index.sizes.tolist()], pa.list_(pa.int64())),
                         **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (("bits", index.bits), ("prints", index.prints), ("counts", index.counts))},
                         "width": pa.array([index.counts.dtype.itemsize], pa.int32())})

    return saved(counted.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, prints binary, counts binary, width int"), "line-index")


def _loaded(part: pa.Table) -> LineIndex:
    row = {c: part.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts", "width")}
    return LineIndex(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], "<u8"), np.frombuffer(row["prints"], "<u4"),
                     np.frombuffer(row["counts"], f"<u{row['width']}"))


def frequent(blocks: DataFrame, index: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """(block, keys): the numbers of a block's keys that are found in `least_docs` documents or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h1, h2 = (batch.column(c)[r].values.to_numpy() for c in ("h1", "h2"))
                shard = h1 % shards
                order = np.argsort(shard, kind="stable")
                used, at = np.unique(shard[order], return_index=True)
                parts = np.split(order, at[1:]) if len(order) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int32)), pa.array([batch.column("block")[r].as_py()] * len(used), pa.int64()),
                    pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary()),
                    pa.array([np.column_stack([h1[p], h2[p]]).astype("<i8").tobytes() for p in parts], pa.binary())], names=["shard", "block", "keys", "hashes"])

    def ask(known: pa.Table, probes: pa.Table) -> pa.Table:
        kinds = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int32()))])
        if not known.num_rows or not probes.num_rows:
            return kinds.empty_table()
        index = _loaded(known)
        keys = [np.frombuffer(x.as_py(), "<i4") for x in probes.column("keys")]
        hashes = np.frombuffer(b"".join(x.as_py() for x in probes.column("hashes")), "<u8").reshape(-1, 2)
        often = index.probe(hashes[:, 0], hashes[:, 1]) >= least_docs
        ends = np.cumsum([len(k) for k in keys])
        found = [(b, k[often[e - len(k): e]]) for b, k, e in zip(probes.column("block").to_pylist(), keys, ends, strict=True)]
        found = [(b, k) for b, k in found if len(k)]
        return pa.table([pa.array([b for b, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int32()))], schema=kinds)

    probes = blocks.select("block", "h1", "h2").mapInArrow(send, "shard int, block long, keys binary, hashes binary")
    asked = index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(ask, "block long, keys array<int>")
    return asked.groupBy("block").agg(F.flatten(F.collect_list("keys")).alias("keys"))  # at most the keys of the block


def dropped_lines(docs: DataFrame, least_docs: int, least_chars: int, text_col: str) -> DataFrame:
    """(k1, k2, n_dropped, flags): for every distinct text that loses lines, by its digest, one byte for each line, 1 if it goes."""
    blocks = line_blocks(docs, text_col, least_chars)
    probes = blocks.agg(F.coalesce(F.sum(F.size("h1")), F.lit(0)).alias("n")).collect()[0]["n"]
    shards = max(-(-probes // SHARD_PROBES), 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = frequent(blocks, line_index(blocks, shards), shards, least_docs)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, k1, k2, sizes, at = (batch.column(c)[r].values.to_numpy() for c in ("keys", "k1", "k2", "sizes", "at"))
                gone = np.zeros(int(at.max(initial=0)) + 2, np.uint8)  # the last one stands for lines without a key
                gone[keys] = 1
                flags = gone[at]
                ends = np.cumsum(sizes)
                n = np.add.reduceat(flags, ends - sizes, dtype=np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array(n[some]),
                                                  pa.array([flags[ends[t] - sizes[t]: ends[t]].tobytes() for t in some], pa.binary())],
                                                 names=["k1", "k2", "n_dropped", "flags"])

    joined = blocks.select("block", "k1", "k2", "sizes", "at").join(often, "block").select("keys", "k1", "k2", "sizes", "at")
    marked = joined.mapInArrow(flag, "k1 long, k2 long, n_dropped long, flags binary")
    return saved(marked.groupBy("k1", "k2").agg(F.first("n_dropped").alias("n_dropped"), F.first("flags").alias("flags")), "dropped-lines")


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_lines (before dropping), n_dropped, kept (the text without lines found in `least_docs` rows or more).

    Lines are compared without white space at their ends and without regard to the case of A to Z; keys of fewer than `least_chars`
    code points are never dropped. Rows are documents, whatever their ids: repeated rows count each, a line repeated inside one text
    counts once. A null or empty text is one empty line. Texts of any length and any number of lines are read whole. An empty table gives
    no rows; columns other than the two named ones are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = dropped_lines(docs, least_docs, least_chars, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *halves(F.md5(F.col("text").cast("binary"))))
    joined = rows.join(sent(gone.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})), ["__k1", "__k2"], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: F.substring("flags", i + 1, F.lit(1)) == F.lit(b"\x00")), "\n")
    return joined.select("id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                         F.when(F.col("flags").isNull(), F.col("text")).otherwise(kept).alias("kept"))


@query("op12_hashed_line_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
