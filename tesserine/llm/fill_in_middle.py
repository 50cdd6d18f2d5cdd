"""Fill-in-the-middle forms of whole texts, cut at unit ends that are found eight bytes at a time.

The UTF-8 bytes of a batch of texts are viewed as 64-bit words. Arithmetic on a word marks the last byte of every unit in the top
bit of that byte (a line ends in its newline, a character before the next byte that starts one); counting the marks of each word and
adding them up gives a directory. "After how many bytes do k units end" is then a binary search in the directory and a select inside
one word, and "how many characters are these bytes" the same directory over the bytes that start a character. No unit becomes an object.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, small_batches, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_HIGH, _REST, _NEWLINES = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE, _EIGHT, _WORD_SHIFT = np.uint64(1), np.uint64(8), np.uint64(56)


def words_of(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, filled up with zeros; one word more than needed, so that the end has a word too."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def char_starts(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte that starts a character: continuation bytes have their top bit set and the next one clear."""
    return _HIGH ^ (words & ~(words << _ONE) & _HIGH)


def unit_ends(words: np.ndarray, unit: str) -> np.ndarray:
    """Top bit of every byte that ends a unit: "line" or "char"."""
    if unit == "line":
        x = words ^ _NEWLINES
        return ~(((x & _REST) + _REST) | x | _REST)  # set exactly where the byte of x is zero
    if unit == "char":
        starts = char_starts(words)
        return (starts >> _EIGHT) | (np.append(starts[1:], _HIGH) << _WORD_SHIFT)
    raise ValueError(f"unknown unit {unit!r}")


class Directory:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before the byte `at`."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((_ONE << bits) - _ONE))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left, m = k - self.before[word], self.marks[word].copy()
        for _ in range(7):  # at most eight marks in a word: clear those before the wanted one
            more = left > 1
            m[more] &= m[more] - _ONE
            left = left - more
        return (word << 3) + (np.bitwise_count((m & (~m + _ONE)) - _ONE) >> 3)


def cuts(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, characters before the first cut, characters between the cuts) of every text of a batch.

    Text t is data[ends[t]:ends[t + 1]]; it is cut after the smaller and after the larger of first % (n + 1) and second % (n + 1) of
    its n units. Bytes after the last marked one are a unit as well.
    """
    words = words_of(data)
    units, chars = Directory(unit_ends(words, unit)), Directory(char_starts(words))
    a, b = ends[:-1].astype(np.int64), ends[1:].astype(np.int64)
    skip, upto = units.rank(a), units.rank(b)
    last = np.maximum(b - 1, 0)
    n = upto - skip + ((b > a) & (units.rank(last + 1) == units.rank(last)))
    x, y = first % (n + 1), second % (n + 1)

    def after(k: np.ndarray) -> np.ndarray:
        closed = (k > 0) & (k <= upto - skip)
        at = np.where(k == 0, a, b)
        at[closed] = units.select((skip + k)[closed]) + 1
        return at

    p, q = after(np.minimum(x, y)), after(np.maximum(x, y))
    return n, chars.rank(p) - chars.rank(a), chars.rank(q) - chars.rank(p)


def _cutter(unit: str):
    @F.arrow_udf("n long, prefix long, middle long")
    def cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        text = text.cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0]: ends[-1]] if raw is not None else np.empty(0, np.uint8)
        parts = cuts(data, ends - ends[0], first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["n", "prefix", "middle"])

    return cut


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, n (units), form, prefix_chars, middle_chars (null if plain), output.

    Draws come from the SHA-256 of seed, ":" and id, so a row's form does not depend on others or on partitions; rows of one id and text are
    formed alike. A null id counts as no digits, a null text as an empty one. Empty texts and texts that hold a mark are plain; `rate` of
    100 are formed, `spm` of 100 of these suffix first. Texts of any length are cut whole; an empty table gives no rows; columns other
    than the two named ones are not read.
    """
    prefix, suffix, middle = marks
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = small_batches(docs.select(F.col(id_col).alias("id"), text.alias("text"))).select("id", "text", *h)
    cut = rows.withColumn("c", _cutter(unit)("text", "h1", "h2"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    formed = cut.select("id", "text", F.col("c.n").alias("n"), form.alias("form"), F.when(~plain, F.col("c.prefix")).alias("prefix_chars"),
                        F.when(~plain, F.col("c.middle")).alias("middle_chars"))
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    before, between = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    after = F.substring("text", p + m + 1, F.length("text"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(prefix), before, F.lit(suffix), after, F.lit(middle), between)).when(
        F.col("form") == "spm", F.concat(F.lit(suffix), after, F.lit(prefix), before, F.lit(middle), between)).otherwise(F.col("text"))
    return formed.withColumn("output", output)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from output and form alone: a text that holds a mark is plain, so a formed output holds each mark once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


@query("op13_swar_fill_in_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle(table(spark, sf_dir, "documents"))
    return formed.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                         F.sha2(restored("output", "form").cast("binary"), 256).alias("restored_sha256"))
