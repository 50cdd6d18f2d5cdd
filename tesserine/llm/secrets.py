"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in whole texts with their positions. Equal candidate values are then counted over the corpus by distinct
repositories and owners: a value that several owners hold is a copied example, a value of a single owner looks live. Formats that
are secrets by their look (`assign`, `access`, `hex`) are always spans; long random-looking strings of no such format become
spans of kind `owned` only if a single owner holds them.

Owners of rows include those of mere copies of a text. Asked by text, each distinct text counts once, for the first of its owners: a
credential whose document was copied to other owners stays live, and only a value that stands in different texts of different owners is
an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.llm.common import query, saved, table, with_texts

#: The formats, in the order that breaks ties. The keyword's letters count in either case, ASCII only.
KEYWORD = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
OWNED = r"([A-Za-z0-9+/_=-]{20,})"
KINDS = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32), ("owned", OWNED, 20))


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Matches of one kind as (k, i, gap, len, value); gap: code points between the match before and this one."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"),
                          F.split(text, pattern, -1).alias("g"))
    rows = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("k"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), z["v"].alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<k:int,i:int,gap:int,len:int,value:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: Column | None = None,
         copied_owners: int = 2, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): one row per input row (uid, id, text_md5), and one row per secret (uid, text_md5, start, end, k, kind,
    value_sha256, owners, repositories, copied).

    `by_text`: adds text_owners, the owners when every distinct text counts once, and live, whether they are fewer than `copied_owners`;
    spans of kind `owned` that are live by text are then kept, too.
    `repository`: expression naming the repository of a row; the owner if none is given. Null text counts as empty, null owner and
    null repository as values of their own. Rows are told apart by a written key, so repeated and null ids are rows of their own.
    Empty tables give empty results; columns other than the named ones are not read. Values leave the scan only as digests.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.col(owner_col) if repository is None else repository
    base = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.md5(text).alias("text_md5"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("\x00")).alias("repo"),
        F.concat(*[_found(text, k, pattern) for k, (_, pattern, _) in enumerate(KINDS)]).alias("found"))
    base = saved(base, "secrets")
    hits = base.where(F.size("found") > 0).select("uid", "text_md5", "owner", "repo", F.inline("found"))
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("uid", "k").orderBy("i"))
    owned = len(KINDS) - 1
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS]), F.col("k") + 1)
    placed = hits.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("len")).where(F.length("value") >= least).where(
        (F.col("k") < owned) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")))
    # a string of no known format counts only where no known format lies
    line = Window.partitionBy("uid").orderBy("start", "k", "end")
    known = F.when(F.col("k") < owned, F.col("end")), F.when(F.col("k") < owned, F.col("start"))
    free = placed.withColumn("to", F.max(known[0]).over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "from", F.min(known[1]).over(line.rowsBetween(1, Window.unboundedFollowing)))
    free = free.where((F.col("k") < owned) | ((F.coalesce("to", F.lit(0)) <= F.col("start")) & (F.coalesce("from", "end") >= F.col("end"))))
    free = free.select("uid", "text_md5", "owner", "repo", "k", "start", "end", F.sha2("value", 256).alias("value_sha256"))
    free = saved(free, "candidates")
    # owners and repositories are made distinct before they are counted: thousands of copies of a value collapse map-side
    pairs = free.groupBy("value_sha256", "owner", "repo").agg(F.lit(1).alias("one"))
    held = pairs.groupBy("value_sha256").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))
    kinds = F.element_at(F.array(*[F.lit(name) for name, _, _ in KINDS]), F.col("k") + 1)
    spans = free.join(held, "value_sha256").withColumn("copied", F.col("owners") >= copied_owners).withColumn("kind", kinds)
    names = ["uid", "text_md5", "start", "end", "k", "kind", "value_sha256", "owners", "repositories", "copied"]
    wanted = ~F.col("copied")
    if by_text:
        # copies of a text collapse to its first owner before owners are made distinct
        first = free.groupBy("value_sha256", "text_md5").agg(F.min("owner").alias("owner"))
        texts = first.groupBy("value_sha256", "owner").agg(F.lit(1).alias("one")).groupBy("value_sha256").agg(F.count("*").alias("text_owners"))
        spans = spans.join(texts, "value_sha256").withColumn("live", F.col("text_owners") < copied_owners)
        names, wanted = [*names, "text_owners", "live"], F.col("live") | wanted
    return base.select("uid", "id", "text_md5"), spans.where((F.col("k") < owned) | wanted).select(*names)


def digest(base: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: counts by kind, the digest of the base spans and all spans as text.

    Of spans scanned by text also n_live_texts and live_spans, those whose value is live by text; the other columns do not change.
    """
    owned, by_text = len(KINDS) - 1, "live" in spans.columns
    shown = (F.col("k") < owned) | ~F.col("copied")
    text = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])), ",")
    per = spans.groupBy("uid").agg(
        *[F.count(F.when(shown & (F.col("k") == k), 1)).alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS)],
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"), F.count(F.when(shown & F.col("copied"), 1)).alias("n_copied"),
        F.sort_array(F.collect_list(F.struct("start", "k", "end", "kind", shown.alias("shown"), (F.col("live") if by_text else F.lit(False)).alias("live")))).alias("all"))
    per = per.select("uid", *[f"n_{name}" for name, _, _ in KINDS], "n_live", "n_copied",
                     F.sha2(text(F.filter("all", lambda r: r["k"] < owned)), 256).alias("base_sha256"), text(F.filter("all", lambda r: r["shown"])).alias("spans"),
                     *([F.size(F.filter("all", lambda r: r["live"])).alias("n_live_texts"), text(F.filter("all", lambda r: r["live"])).alias("live_spans")] if by_text else []))
    none = F.sha2(F.lit(""), 256)
    counts = [f"n_{name}" for name, _, _ in KINDS] + ["n_live", "n_copied"] + (["n_live_texts"] if by_text else [])
    return base.join(per, "uid", "left").select(
        "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("base_sha256", none).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), *([F.coalesce("live_spans", F.lit("")).alias("live_spans")] if by_text else []))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", **names) -> DataFrame:
    """`docs` with every span that is not a copied example (with `by_text=True`: that is live by text) replaced by `mask`; other rows and
    columns stay as they are."""
    _, spans = scan(docs, text_col=text_col, **names)
    live = spans.where(F.col("live") if "live" in spans.columns else ~F.col("copied")).select("text_md5", "start", "end").distinct()
    line = Window.partitionBy("text_md5").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("at", F.coalesce(F.max("end").over(line), F.lit(0)))
    cuts = live.groupBy("text_md5").agg(F.sort_array(F.collect_list(F.struct("start", "end", "at"))).alias("__cuts"), F.max("end").alias("__rest"))
    text = F.col(text_col)
    kept = F.transform("__cuts", lambda c: F.when(c["start"] >= c["at"], F.concat(
        text.substr((c["at"] + 1).cast("int"), (c["start"] - c["at"]).cast("int")), F.lit(mask))).otherwise(F.lit("")))
    whole = F.concat(F.array_join(kept, ""), text.substr((F.col("__rest") + 1).cast("int"), F.length(text)))
    cuts, md5 = saved(cuts, "cuts"), F.md5(F.coalesce(text, F.lit("")))
    hit = with_texts(docs, md5, cuts, "left_semi").join(cuts.withColumnRenamed("text_md5", "__md5"), md5 == F.col("__md5"))
    return hit.withColumn(text_col, whole).select(*docs.columns).union(with_texts(docs, md5, cuts, "left_anti"))


@query("op3_secret_ownership")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, spans = scan(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"), by_text=True)
    return digest(base, spans).withColumnRenamed("id", "doc_id")
