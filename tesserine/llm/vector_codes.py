"""Product codes of vectors, assigned by a walk over the lexicographic trie of distinct parts.

A vector becomes whole numbers and is cut into parts; every part position has its own codebook. The distinct parts of a batch, sorted, are
the leaves of a trie whose levels are the part's dimensions. A node carries the squared distances of its prefix to all entries, so
parts that begin alike share those sums; a leaf takes the nearest entry and adds its weighted components to that entry's sums. The
walk goes depth first, and subtrees that fit a block are finished level by level.

A round is one scan: only 16 x 64 partial sums leave a batch, so no part is ever shuffled, and equal vectors of a batch meet in one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, saved, sent, table

#: Vectors whose parts share a trie, leaves of a subtree that is finished at once, and the largest component: sums of squares stay exact.
CHUNK, BLOCK, LARGEST = 32_768, 2_048, 1 << 28


def whole_vectors(rows: DataFrame, dims: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x): floor(scale * component) of the vectors that count."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(v.isNotNull() & (F.size(v) == dims) & F.coalesce(fine, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(x) and max(-int(x.min()), int(x.max())) > LARGEST:
        raise ValueError(f"a scaled component exceeds {LARGEST}")
    return x


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, the place of every row among them, how often each comes)."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ranked[at], place, np.diff(np.append(at, len(ranked)))


def nearest_entries(leaves: np.ndarray, book: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of distinct parts in lexicographic order; the first of equally near entries."""
    width, code, far = leaves.shape[1], np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)

    def starts(depth: int, lo: int, hi: int) -> np.ndarray:
        """Where the children of a node of this depth begin."""
        return lo + np.flatnonzero(np.append(True, leaves[lo + 1: hi, depth] != leaves[lo: hi - 1, depth]))

    def walk(depth: int, lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo > block and depth < width:
            at = starts(depth, lo, hi)
            for a, b in zip(at, np.append(at[1:], hi), strict=True):
                walk(depth + 1, a, b, held + (leaves[a, depth] - book[:, depth]) ** 2)
            return
        nodes, sums = np.array([lo]), held[None, :]
        for d in range(depth, width):
            firsts = np.ones(hi - lo, bool)
            firsts[1:] = (leaves[lo + 1: hi, depth: d + 1] != leaves[lo: hi - 1, depth: d + 1]).any(axis=1)
            child = lo + np.flatnonzero(firsts)
            parent = np.searchsorted(nodes, child, side="right") - 1
            sums, nodes = sums[parent] + (leaves[child, d][:, None] - book[None, :, d]) ** 2, child
        code[nodes], far[nodes] = sums.argmin(axis=1), sums.min(axis=1)

    if len(leaves):
        walk(0, 0, len(leaves), np.zeros(len(book), np.int64))
    return code, far


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined until they hold `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of an entry's parts; an entry without parts stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK):
            x = _matrix(chunk.column(0).combine_chunks(), parts * width)
            for p in range(parts):
                leaves, _, times = _distinct(x[:, p * width: (p + 1) * width])
                code, _ = nearest_entries(leaves, books[p])
                weighted = np.zeros((entries, width + 1), np.int64)
                np.add.at(weighted, code, np.column_stack([leaves * times[:, None], times]))
                used = np.flatnonzero(weighted[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)),
                                                  *[pa.array(weighted[used, d]) for d in range(width + 1)]], names=["part", "entry", *names])

    names = [*[f"s{d}" for d in range(width)], "n"]
    made = vectors.select("x").mapInArrow(sums, "part int, entry int, " + ", ".join(f"{c} long" for c in names))
    # sums beyond a long stay exact; one row per entry comes back
    rows = made.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [int(r[c]) // int(r["n"]) for c in names[:-1]]
    return out


def fit_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """(parts, entries, width) after all rounds, from a table of `whole_vectors`; the first entries are the vectors of the least ids."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()  # as many rows as entries
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, codes, distances): entry and squared distance of every part."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK):
            x = _matrix(chunk.column("x").combine_chunks(), parts * width)
            codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
            for p in range(parts):
                leaves, place, _ = _distinct(x[:, p * width: (p + 1) * width])
                code, d = nearest_entries(leaves, books[p])
                codes[:, p], far[:, p] = code[place], d[place]
            ends = pa.array(np.arange(0, parts * len(x) + 1, parts, dtype=np.int32))
            for batch in pa.table([chunk.column("id"), chunk.column("label"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel().astype(np.int32))),
                                   pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=["id", "label", "codes", "distances"]).to_batches():
                yield batch

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, distances array<long>")


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, distances) of every vector that counts, and the codebooks.

    Vectors that are null, of another length than `dims`, or hold a null, NaN or infinite component are left out. Null ids come after
    all others; rows of one id are ordered by their components; repeated rows each count and get equal codes. With fewer vectors
    than entries the codebooks have that many entries, with none the result is empty. Components beyond 2**28 after scaling are an
    error. Columns other than the three named ones are not read.
    """
    if dims % parts:
        raise ValueError("parts must divide dims")
    vectors = saved(whole_vectors(rows, dims, scale, id_col, vector_col, label_col), "vectors")
    books = fit_codebooks(vectors, parts, entries, rounds)
    if not books.size:
        return vectors.select("id", "label", F.array().cast("array<int>").alias("codes"), F.array().cast("array<long>").alias("distances")), books
    return encode(vectors, books), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@query("op11_trie_vector_codes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    rows = saved(coded.select("id", "label", hexed.alias("code"), error.alias("error")), "codes")
    per = saved(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(sent(per.select(F.col("label").alias("of"), "label_error")), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
