"""Packing by exact-complement hashing, then best fit.

Pieces are tokenized where they lie; only the histogram of their lengths (at most one row per length up to the capacity) is
planned on. For the longest length left, its gap is filled by one length, two or three whose sum is exactly the gap and which
are still available; such a combination is used as often as its counts allow. Where no sum fits, the longest length that fits goes
in and the smaller gap is looked up again. The plan is a table of rank ranges per length, which the pieces look up by their rank.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, ranked_in_buckets, row_buckets, saved, small_batches, table

#: Words whose ids a worker remembers, and characters of text that are split at a time.
REMEMBERED, SPLIT_AT = 400_000, 500_000
#: A special token of the vocabulary, by its id; it never comes out of a word without `<|`.
PARTING = 49407
_TAIL = b".,;:!?|%*&$#"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec), {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


_LETTERS = _byte_letters()


def _learn(tokenizer, known: dict[bytes, bytes], words: list[bytes]) -> None:
    """Put the ids of new words into `known`.

    Closing punctuation is a token run of its own, so a word is looked up as its stem and its tail. Stems of small letters need no
    normalizing or splitting and go to the tokenizer's model; all else goes through the whole tokenizer, many words to a call,
    parted by a special token whose id parts the ids again.
    """
    stems, model = {}, tokenizer.model
    for word in words:
        stem = word.rstrip(_TAIL)
        if stem and stem is not word and len(stem) < len(word) and stem.decode()[-1].isalpha():
            stems[word] = (stem, word[len(stem):])
    rest = []
    for word in {*(w for w in words if w not in stems), *(x for pair in stems.values() for x in pair)}:
        if word in known:
            continue
        text = word.decode()
        if text.isalpha() and (text.isascii() or text == text.lower() and is_normalized("NFC", text)):
            mapped = text if text.isascii() else word.decode("latin-1").translate(_LETTERS)
            known[word] = array("I", [t.id for t in model.tokenize(mapped)]).tobytes()
        else:
            rest.append(word)
    part = tokenizer.id_to_token(PARTING)
    for at in range(0, len(rest), 500):
        some = rest[at: at + 500]
        ids = np.asarray(tokenizer.encode_batch_fast([part.join(w.decode() for w in some)], add_special_tokens=False)[0].ids, "<u4")
        raw, start = ids.tobytes(), 0
        for word, end in zip(some, [*np.flatnonzero(ids == PARTING).tolist(), len(ids)], strict=True):
            known[word] = raw[4 * start: 4 * end]
            start = end + 1
    for word, (stem, tail) in stems.items():
        known[word] = known[stem] + known[tail]


def token_bytes(texts: list[str], spec: str) -> list[bytes]:
    """The ids of every text as little-endian unsigned 32-bit bytes.

    White space ends a token and leaves none in this vocabulary, and capitals count as small letters, so a text's ids are those
    of its words one after another; the tokenizer is asked once for each word it has not seen. A text with `<|` in it, which may
    hold a special token, goes to the tokenizer whole.
    """
    tokenizer, known = _tokenizer(spec)
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SPLIT_AT):
            size += len(texts[upto])
            upto += 1
        words = [None if "<|" in t else t.encode().translate(_LOWER).split() for t in texts[at:upto]]
        local = dict.fromkeys(set().union(*filter(None, words)))
        new = [w for w in local if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(local)
        _learn(tokenizer, known, new)
        for text, w in zip(texts[at:upto], words, strict=True):
            out.append(b"".join(map(known.__getitem__, w)) if w is not None else np.asarray(
                tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        at = upto
    return out


def pieces(docs: DataFrame, spec: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Every document ends with `end_id`; only documents longer than the capacity are cut.

    Null text counts as empty (one piece: the end id); a null id stays null; repeated rows give pieces of their own; an empty
    table gives none.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, ids in enumerate(token_bytes(batch.column(1).to_pylist(), spec)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo: lo + 4 * capacity]
                    owner.append(i)
                    rows.append((k, lo // 4, len(part) // 4, zlib.crc32(part)))
            k, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(k, pa.int32()), *(
                pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(cut, PIECES)


class _Lengths:
    """Available lengths with counts; bit x of `bits` is set while length x is available, bit `capacity - x` of `mirror` likewise."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.bits = sum(1 << x for x, n in counts.items() if n)
        self.mirror = sum(1 << (capacity - x) for x, n in counts.items() if n)

    def take(self, x: int, n: int = 1) -> None:
        self.left[x] -= n
        if not self.left[x]:
            self.bits &= ~(1 << x)
            self.mirror &= ~(1 << (self.capacity - x))

    def give(self, x: int) -> None:
        self.left[x] += 1
        self.bits |= 1 << x
        self.mirror |= 1 << (self.capacity - x)

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1

    def pair(self, total: int) -> tuple[int, ...]:
        """Two available lengths of this sum, the longest first: x is one if both x and total - x are available."""
        x = (self.bits & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)).bit_length() - 1
        return () if x < 1 or 2 * x == total and self.left[x] < 2 else (x, total - x)

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that fill the gap exactly."""
        if self.bits >> gap & 1:
            return (gap,)
        if found := self.pair(gap):
            return found
        x = self.longest(gap - 2)
        while 3 * x >= gap > 2:
            self.take(x)
            found = self.pair(gap - x)
            self.give(x)
            if found:
                return (x, *found)
            x = self.longest(x - 1)
        return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences); uses up `counts`."""
    have, out = _Lengths(counts, capacity), []
    while have.bits:
        first = have.longest(capacity)
        have.take(first)
        parts, gap = [first], capacity - first
        while gap > 0 and have.bits:
            found = have.exact(gap) or ((x,) if (x := have.longest(gap)) > 0 else ())
            if not found:
                break
            for x in found:
                have.take(x)
                gap -= x
            parts += found
        used = Counter(parts)
        more = min(have.left[x] // n for x, n in used.items())
        for x, n in used.items():
            if more:
                have.take(x, more * n)
        out.append((parts, more + 1))
    return out


def ranges(plan_rows: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by rank within a length: from `rank` on, `each` pieces of `length` go to every sequence from `sequence`, at `offset`."""
    rows, used, sequence = [], Counter(), 0
    for parts, times in plan_rows:
        offset = 0
        for x, each in Counter(parts).items():
            rows.append((x, used[x], each, sequence, offset))
            used[x] += each * times
            offset += x * each
        sequence += times
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table_.T, strict=True))


def pack(docs: DataFrame, spec: str, capacity: int = 4096, end_id: int = 1, **names: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(pieces(small_batches(docs), spec, capacity, end_id, **names), "pieces")
    # at most one row per length, so at most `capacity` rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = ranges(plan(counts, capacity))
    buckets = row_buckets(sum(counts.values()))
    h = F.xxhash64("id", "piece", "ids_crc32")
    ranked = ranked_in_buckets(cut.withColumn("h", h), F.pmod("h", F.lit(buckets)).cast("int"), buckets,
                               [F.col("h"), F.col("id"), F.col("piece"), F.col("start")], "rank", by="length")
    shared = spark.sparkContext.broadcast(places)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted((p["length"] << 44) + p["rank"], (length << 44) + rank, side="right") - 1
        r = rank - p["rank"][k]
        return pd.DataFrame({"sequence_id": p["sequence"][k] + r // p["each"][k], "offset": p["offset"][k] + r % p["each"][k] * length})

    return ranked.withColumn("at", place("length", "rank")).select("id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's file as text; it travels to the workers with the function."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op10_exact_complement_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")
