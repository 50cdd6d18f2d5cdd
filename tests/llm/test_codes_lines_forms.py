"""Vector codes, line deduplication and fill-in-the-middle forms against brute force, with edge cases."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import fill_in_middle as fim
from tesserine.llm import line_dedup, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns whose names the operators use."""
    long = "\n".join(f"line {i % 40_000} é" for i in range(60_000))
    rows = [(1, "a\nb\n"), (1, "a\nb\n"), (2, None), (3, ""), (None, "\n\n"), (None, None), (4, long), (5, " A \nno <S> here"), (6, "🙂é\nx"), (7, "no end\nof line"), (8, "\n")]
    return spark.createDataFrame([(i, t, 7, "x", "y", 1, 2, 3) for i, t in rows], "doc_id long, text string, n long, form string, output string, k1 long, h1 long, id long")


# -- fill in the middle --------------------------------------------------------------


def form_by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, text
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(lines), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_forms_match_brute_force_and_give_the_text_back(spark, docs, odd):
    for table in (docs.select("doc_id", "text"), odd):
        want = collections.Counter((r.doc_id, *form_by_hand(r.doc_id, r.text)) for r in table.collect())
        rows = fim.fill_in_middle(table).withColumn("back", fim.restored("output", "form")).collect()
        assert collections.Counter((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want
        assert all(r.back == r.text for r in rows)
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_rates_marks_and_characters(spark):
    table = spark.createDataFrame([(i, "αβγ delta\nε <P>" + "🙂" * (i % 9)) for i in range(300)], "doc_id long, text string")
    rows = fim.fill_in_middle(table, rate=60, spm=0, unit="char", marks=("[p]", "[s]", "[m]")).withColumn("back", fim.restored("output", "form", ("[p]", "[s]", "[m]"))).collect()
    forms = collections.Counter(r.form for r in rows)
    assert forms["spm"] == 0 and 0.5 < forms["psm"] / 300 < 0.7 and all(r.back == r.text and r.n == len(r.text) for r in rows)
    assert len({r.prefix_chars for r in rows}) > 8


@pytest.mark.parametrize("unit", ["line", "char"])
def test_cuts_of_random_bytes(unit):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab\n\n é漢🙂"), rng.integers(0, 60))) for _ in range(400)] + ["", "\n" * 70, "x" * 70, "\x80\x8a\x0a"]
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    first, second = rng.integers(0, 1 << 32, len(texts)), rng.integers(0, 1 << 32, len(texts))
    n, pre, mid = fim.cuts(np.frombuffer(b"".join(raw), np.uint8), ends, first, second, unit)
    for k, t in enumerate(texts):
        parts = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
        a, b = sorted((first[k] % (len(parts) + 1), second[k] % (len(parts) + 1)))
        assert (n[k], pre[k], mid[k]) == (len(parts), len("".join(parts[:a])), len("".join(parts[a:b])))


def test_every_byte_value_is_marked_right():
    data = np.concatenate([np.arange(256), np.full(9, 10), np.arange(255, -1, -1)]).astype(np.uint8)
    words = fim.words_of(data)
    marked = (fim.unit_ends(words, "line").view(np.uint8) >> 7)[: len(data)]
    assert (marked == (data == 10)).all()
    assert ((fim.char_starts(words).view(np.uint8) >> 7)[: len(data)] == ((data & 0xC0) != 0x80)).all()


# -- lines -----------------------------------------------------------------------------


def lines_by_hand(rows, least, chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def same_lines(table, least, **more):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = line_dedup.drop_frequent_lines(table, least, **({"least_chars": more["chars"]} if more else {})).collect()
    assert collections.Counter((r.id, r.n_lines, r.n_dropped, r.kept) for r in got) == lines_by_hand(rows, least, **more)
    return got


@pytest.mark.parametrize("least", [2, 3, 10])
def test_lines_match_brute_force(docs, least):
    assert any(r.n_dropped for r in same_lines(docs, least))


def test_line_edges(odd):
    same_lines(odd, 2)
    same_lines(odd, 2, chars=2)
    assert line_dedup.drop_frequent_lines(odd.limit(0)).count() == 0


def test_a_line_of_a_third_of_all_rows_and_many_blocks(spark):
    rows = [(i, "\n".join([" SAME line", f"own {i}", f"pair {i // 2}", f"ten {i // 10}", "", f"ten {i // 10} "] if i % 3 == 0 else [f"own {i}", f"TEN {i // 10}"])) for i in range(3000)]
    got = {r.id: r for r in same_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 10)}
    assert all("SAME" not in r.kept and f"own {i}" in r.kept and "ten" not in r.kept.lower() for i, r in got.items())


def test_index_is_minimal_perfect_and_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        counts = rng.integers(1, 400, n)
        index = line_dedup.LineIndex.build(h[0], h[1], counts)
        assert sorted(index._slots(h[0], h[1])) == list(range(n)) and len(index.counts) == n
        assert (index.probe(h[0], h[1]) == counts).all()
        assert index.probe(h[1], h[0]).sum() == 0  # keys that were never counted
        assert 64 * index.sizes.sum() < 5 * n + 200
    big = line_dedup.LineIndex.build(np.array([1], np.uint64), np.array([2], np.uint64), np.array([1 << 40]))
    assert big.counts.itemsize == 8 and big.probe(np.array([1], np.uint64), np.array([2], np.uint64))[0] == 1 << 40


# -- vector codes ----------------------------------------------------------------------


def codes_by_hand(rows, parts=16, entries=64, rounds=2, dims=64):
    kept = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = dims // parts
    cut = lambda x, p: x[p * w: (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for _, x, _ in kept:
                of[near(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for i, x, label in kept:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, label, tuple(k for _, k in best), tuple(d for d, _ in best)))
    return collections.Counter(out), books


def check_codes(table, **more):
    rows = [(r.vec_id, r.embedding, r.label) for r in table.select("vec_id", "embedding", "label").collect()]
    coded, books = vector_codes.compress(table, **more)
    want, want_books = codes_by_hand(rows, **more)
    assert books.tolist() == want_books
    assert collections.Counter((r.id, r.label, tuple(r.codes), tuple(r.distances)) for r in coded.collect()) == want
    return want


VECTORS = "vec_id long, embedding array<float>, label int, x string, id long, codes string"


def test_codes_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    assert len(check_codes(rows, entries=8, rounds=2)) == 150


def test_code_edges(spark):
    rng = np.random.default_rng(2)
    base = [[float(x) for x in rng.integers(-3, 4, 8) / 256 + 0.001] for _ in range(30)]
    rows = [(i % 25 if i % 7 else None, v, i % 3 if i % 5 else None) for i, v in enumerate(base + base[:10])]
    rows += [(90, None, 1), (91, [0.0] * 7 + [float("nan")], 1), (92, [float("inf")] + [0.0] * 7, 1), (93, [None] + [0.0] * 7, 1), (94, [], 1), (95, [0.0] * 9, 1), (1, [-0.0039] * 8, None)]
    table = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], VECTORS)
    assert sum(check_codes(table, parts=2, entries=6, rounds=3, dims=8).values()) == 41
    assert sum(check_codes(table, parts=4, entries=100, rounds=2, dims=8).values()) == 41  # fewer vectors than entries
    coded, books = vector_codes.compress(table.where("vec_id = 91"), parts=2, dims=8)
    assert coded.count() == 0 and books.size == 0 and len(vector_codes.codebook_digest(books)) == 64
    assert vector_codes.compress(table.limit(0), parts=2, dims=8)[0].count() == 0
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress(table, parts=3, dims=8)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_trie_walk_does_not_depend_on_its_blocks(block):
    rng = np.random.default_rng(block)
    parts, book = rng.integers(-4, 5, (900, 4)), rng.integers(-4, 5, (16, 4))
    book[9] = book[3]  # equally near: the first one
    leaves, place, times = vector_codes._distinct(parts)
    assert (leaves[place] == parts).all() and times.sum() == 900
    code, far = vector_codes.nearest_entries(leaves, book, block)
    d = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all() and 9 not in code


def test_queries_read_nothing_twice_by_join(spark):
    """Codes and forms need no shuffle of rows; lines travel as packed hashes."""
    coded, _ = vector_codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"), entries=4)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    formed = fim.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet"))
    assert "Exchange" not in formed._jdf.queryExecution().executedPlan().toString()
    assert formed.agg(F.count("*")).first()[0] == 200
