"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Every benchmark item is held against windows of its own length in words, cut short by the text's end. A window that reaches the
similarity holds that share of the item's weight or more, so windows are cut at every place where the shingles of items of that
length add up to it; what the weights and the text's ends allow needs no bound of its own. Windows and items get 64-bit SimHash fingerprints. Fingerprints within
`RADIUS` bits agree in at least one of `RADIUS + 1` blocks, so the block index finds all of them among the items of that length;
candidates are then compared exactly by weighted shingles. Equal windows are fingerprinted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.llm.common import SENT_ROWS, query, saved, table, with_texts

#: Words of a shingle, similarity that counts as a leak, bits by which fingerprints may differ.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 22
BITS = 64
#: An item's whole weight when the parts of its shingles are added up: whole numbers, rounded up, so that a sum is never too small.
WHOLE = 10**9
#: Words are runs of letters and digits, in small letters: case and punctuation do not hide a leak.
APART = r"[^\p{L}\p{N}]+"


def _split(text: Column | str) -> Column:
    """Words of a text; the first and the last may be empty."""
    return F.split(F.lower(text), APART)


def _words(text: Column) -> Column:
    return F.filter(_split(F.coalesce(text, F.lit(""))), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Distinct shingles of an array of words; a shorter array is one shingle, an empty one has none."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))))


def _fingerprint(shingles: Column, weights: Column) -> Column:
    """SimHash: bit b is set where the votes of shingles whose hash has it outweigh the others.

    A vote is the square root of the weight: angles follow squared votes, so fingerprints of two sets differ as their shared and whole
    weights say, however unevenly the weights are spread. Plain weights would let one heavy shingle outvote a hundred light ones.
    """
    pairs = F.zip_with(shingles, weights, lambda s, w: F.struct(F.xxhash64(s).alias("h"), F.sqrt(w).alias("w")))

    def bit(b: Column) -> Column:
        votes = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(F.getbit(p["h"], b) == 1, p["w"]).otherwise(-p["w"]))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(fingerprint: Column) -> Column:
    """(block, value) of every block; the first blocks are a bit longer where the bits do not divide evenly."""
    count = RADIUS + 1
    base, longer = divmod(BITS, count)
    out, at = [], 0
    for k in range(count):
        width = base + (k < longer)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(k).alias("block"), value.cast("int").alias("value")))
        at += width
    return F.array(*out)


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n, shingles) of the items that have words."""
    rows = items.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return rows.select("item", "words", F.size("words").alias("n"), _shingles(F.col("words")).alias("shingles"))


def shingle_weights(items: DataFrame) -> DataFrame:
    """(shingle, weight): the fewer items hold a shingle, the more it weighs; one of a single item, or of none, weighs most."""
    held = items.select("item", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    return held.select("shingle", (1.0 / F.col("df")).alias("weight"))


def _grams(words: Column) -> Column:
    """Rows (pos, w1, ..., w5): every word with those after it, null past the end."""
    n = F.size(words)
    later = [F.slice(words, k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k + 1}") for k in range(SHINGLE)]
    return F.inline(F.when(n > 0, F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("pos"), *later)))


def _standing(texts: DataFrame, known: DataFrame) -> DataFrame | None:
    """(text_md5, n, pos, part): where a shingle of an item of n words stands in a text, and the largest part of such an item's weight it is."""
    grams = texts.select(F.md5("text").alias("text_md5"), _split("text").alias("words")).select("text_md5", _grams(F.col("words")))
    each = known.select("n", "total", F.explode(F.arrays_zip("shingles", "weights")).alias("s"))
    marks = saved(each.groupBy("n", F.split("s.shingles", " ").alias("w")).agg(F.max(F.ceil(F.col("s.weights") / F.col("total") * WHOLE)).alias("part")), "marks")
    out = None
    for r in marks.groupBy(F.size("w").alias("span")).agg(F.count("*").alias("rows")).collect():  # at most SHINGLE spans
        names = [f"w{k + 1}" for k in range(r["span"])]
        some = marks.where(F.size("w") == r["span"]).select(*[F.col("w")[k].alias(name) for k, name in enumerate(names)], "n", "part")
        found = grams.where(F.col(names[-1]).isNotNull()).join(F.broadcast(some) if r["rows"] <= SENT_ROWS else some, names)
        found = found.select("text_md5", "n", "pos", "part")
        out = found if out is None else out.union(found)
    return out


def _starts(hits: DataFrame) -> DataFrame:
    """(text_md5, n, starts): every start of a window of n words whose shingles can reach `SIMILARITY` with an item of that length.

    A window of that similarity holds at least as large a share of the item's weight. A shingle counts for the windows that begin up
    to n - SHINGLE words before it and not before the text, so the sum over a window changes only where one enters or leaves.
    """
    first = F.greatest(F.col("pos") - F.col("n") + F.least("n", F.lit(SHINGLE)), F.lit(0))
    change = hits.distinct().select("text_md5", "n", F.inline(F.array(
        F.struct(first.alias("start"), F.col("part").alias("by")), F.struct((F.col("pos") + 1).alias("start"), (-F.col("part")).alias("by")))))
    line = Window.partitionBy("text_md5", "n").orderBy("start")  # rows of one start count together
    sums = change.select("text_md5", "n", "start", F.sum("by").over(line).alias("held"), F.lead("start").over(line).alias("next"))
    runs = sums.where((F.col("held") >= int(SIMILARITY * WHOLE) - 1) & (F.col("next") > F.col("start")))
    return runs.groupBy("text_md5", "n").agg(F.flatten(F.collect_list(F.sequence("start", F.col("next") - 1))).alias("starts"))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_md5, item, start, n_words, similarity): the most similar window of each text for every item it leaks, the first one of equals.

    Null texts and items without words leak nothing. Texts are told apart by digest, so equal texts are searched once and ids do not
    matter; repeated items each get their rows. Empty tables give no rows; columns other than the named ones are not read.
    """
    items = saved(benchmark_items(benchmark, item_id, item_text), "items")
    weights = saved(shingle_weights(items), "weights")
    known = saved(_weighted(items.select("item", "n", "shingles"), weights, ["item", "n"]), "fingerprints")
    # (1) where shingles of items stand in the texts: one pass over the words
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    hits = _standing(texts, known)
    if hits is None:
        return items.select(F.lit("").alias("text_md5"), "item", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    return _windows(texts, saved(_starts(hits), "starts"), known, weights)


def _windows(texts: DataFrame, starts: DataFrame, known: DataFrame, weights: DataFrame) -> DataFrame:
    # (2) windows at those places, from one copy of every text that has any
    some = with_texts(texts, F.md5("text"), starts, "left_semi").withColumn("text_md5", F.md5("text")).dropDuplicates(["text_md5"])
    cut = some.select("text_md5", _split("text").alias("words")).join(starts, "text_md5")
    place = cut.select("text_md5", "n", F.inline(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.col("n")).alias("words")))))
    windows = saved(place.withColumn("window", F.xxhash64("n", F.array_join("words", " "))), "windows")
    # (3) fingerprints of distinct windows and of items
    distinct = windows.groupBy("window", "n").agg(F.first("words").alias("words")).withColumn("shingles", _shingles(F.filter("words", lambda w: w != "")))
    distinct = saved(_weighted(distinct.select("window", "n", "shingles"), weights, ["window", "n"]), "distinct")
    blocks = lambda df, *names: df.select(*names, F.inline(_blocks(F.col("fingerprint"))))
    near = blocks(distinct, "window", "n", "fingerprint").join(blocks(known, "item", "n", F.col("fingerprint").alias("other")), ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= RADIUS).select("window", "n", "item").distinct()
    # (4) exact weighted similarity of the candidates
    pairs = near.join(distinct.select("window", F.col("shingles").alias("ws"), F.col("total").alias("wt")), "window").join(
        known.select("item", F.col("shingles").alias("ks"), F.col("weights").alias("kw"), F.col("total").alias("kt")), "item")
    shared = F.aggregate(F.filter(F.arrays_zip("ks", "kw"), lambda p: F.array_contains("ws", p["ks"])), F.lit(0.0), lambda a, p: a + p["kw"])
    pairs = pairs.withColumn("similarity", F.round(shared / (F.col("wt") + F.col("kt") - shared), 9)).where(F.col("similarity") >= SIMILARITY)
    where = windows.select("text_md5", "n", "start", "window").join(pairs.select("window", "item", "similarity"), "window")
    best = where.groupBy("text_md5", "item").agg(F.max_by(F.struct("start", "n", "similarity"), F.struct(F.col("similarity"), -F.col("start"))).alias("b"))
    return saved(best.select("text_md5", "item", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity")), "leaks")


def _weighted(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the weights of their shingles, their total and the fingerprint."""
    each = rows.select(*keys, F.explode("shingles").alias("shingle")).join(weights, "shingle", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    lists = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("shingle", "weight"))).alias("l"))
    lists = lists.select(*keys, F.col("l.shingle").alias("shingles"), F.col("l.weight").alias("weights"))
    return lists.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)).withColumn(
        "fingerprint", _fingerprint(F.col("shingles"), F.col("weights")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of `docs` whose text leaks no item."""
    return with_texts(docs, F.md5(F.col(text_col)), leaks(docs, benchmark, text_col=text_col, **names), "left_anti")


@query("op4_simhash_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.md5("text").alias("text_md5")).join(found, "text_md5").select(
        "doc_id", F.col("item").alias("item_id"), "start", "n_words", "similarity", F.lit(True).alias("contaminated"))
