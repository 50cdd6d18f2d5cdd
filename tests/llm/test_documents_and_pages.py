"""Near-duplicates, decontamination, pages, archives, chat and toxicity against brute force, with edge cases."""

import collections
import hashlib
import html as entities
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tesserine.llm import chat, decontamination, html_text, near_duplicates, toxicity, warc
from tesserine.llm.common import components, shared_folder

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < width else frozenset(zip(*[words[k:] for k in range(width)], strict=False))


def components_by_hand(texts, width, percent):
    """id -> least id reachable, by comparing every pair."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    ids, group = sorted(sets), {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, docs, width, percent):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in range(120):  # copies with edits: some pairs link, some only through others
        words = list(base)
        for at in rng.integers(0, 150, 1 + k % 6):
            words[at] = f"x{k}"
        texts[100_000 + k] = " ".join(words).upper() if k % 7 == 0 else " ".join(words)
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sets = components_by_hand(texts, width, percent)
    rows = near_duplicates.near_duplicates(made, width=width, percent=percent).collect()
    assert {r.id: r.component_id for r in rows} == want and len(rows) == len(texts)
    assert all(r.n_shingles == len(sets[r.id]) and r.kept == (r.id == want[r.id]) for r in rows)
    left = near_duplicates.one_of_each(made, width=width, percent=percent)
    assert {r.doc_id for r in left.collect()} == set(want.values()) and left.columns == made.columns


def test_near_duplicate_edges(spark):
    rows = [(5, "same text here now", 1), (3, "SAME text here now", 2), (None, "same text here now", 3), (7, None, 4), (8, "", 5), (9, " \n", 6), (9, " \n", 6), (1, "one", 7), (2, "One", 8),
            (None, None, 9)]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node long")).collect()
    got = sorted((str(r.id), r.n_shingles, r.component_id, r.kept) for r in out)
    assert got == sorted([("5", 2, 3, False), ("3", 2, 3, True), ("None", 2, 3, False), ("7", 0, 7, True), ("8", 0, 8, True), ("9", 0, 9, True), ("9", 0, 9, True),
                          ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, True)])
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_near_the_similarity(spark):
    a = near_duplicates.shingle_set(" ".join(f"w{i}" for i in range(2000)), 3)
    b = near_duplicates.shingle_set(" ".join(f"w{i}" for i in range(500, 2500)), 3)
    bits = [near_duplicates.packed_bits(near_duplicates.minima(s)).tolist() for s in (a, b)]
    row = spark.createDataFrame([tuple(bits)], "a array<long>, b array<long>").select(near_duplicates.estimate(F.col("a"), F.col("b")).alias("e")).first()
    assert abs(row.e - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + k) for k in range(1, 40)] + [(301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + k: 200 for k in range(40)}, 300: 300, 301: 300}


WORDS = regex.compile(r"[\p{L}\p{N}]+")


def grams(words):
    return {" ".join(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def leaks_by_hand(texts, items):
    """(text, item) -> (similarity, start): every window of every item's length."""
    lists = {i: WORDS.findall((t or "").lower()) for i, t in items.items()}
    held = collections.Counter(s for w in lists.values() for s in grams(w))
    weigh = lambda s: sum(1 / max(held[x], 1) for x in s)
    out = {}
    for d, t in texts.items():
        words = WORDS.findall((t or "").lower())
        for i, item in lists.items():
            want = grams(item)
            for a in range(len(words)) if item else ():
                have = grams(words[a: a + len(item)])
                if have & want:
                    s = weigh(have & want)
                    s = round(s / (weigh(have) + weigh(want) - s), 9)
                    if s >= 0.8 and s > out.get((d, i), (0, 0))[0]:
                        out[d, i] = (s, a)
    return out


def test_leaks_match_every_window(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()} | {900: None, 901: "", 902: "tiny item", 903: "exactly five words are here"}
    some = WORDS.findall(items[0])
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()} | {
        500: "Start " + " ".join(some) + " end", 501: " ".join(some[1:]).upper(), 502: "!! " + " -- ".join(some), 503: " ".join(some[: len(some) // 2]),
        504: "a tiny   ITEM", 505: None, 506: "", 507: "x exactly, five words are here y", 508: " ".join(some[:10] + ["odd"] + some[10:])}
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("n", F.lit(1))
    found = made.select("doc_id", F.md5("text").alias("text_md5")).join(decontamination.leaks(made, bench), "text_md5").collect()
    want = leaks_by_hand(texts, items)
    assert {(r.doc_id, r.item) for r in found} == set(want) and {500, 501, 502, 504, 507} <= {d for d, _ in want}
    assert all(abs(r.similarity - want[r.doc_id, r.item][0]) < 1e-6 for r in found)
    left = {r.doc_id for r in decontamination.clean_documents(made, bench).collect()}
    assert left == set(texts) - {d for d, _ in want}


def test_leaks_of_items_cut_by_the_ends_of_a_text(spark):
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    plain, preamble, other = fresh(100), fresh(40), fresh(60)
    lists = {1: plain, 2: fresh(150)} | {10 + k: preamble + fresh(60) for k in range(12)}
    texts = {k: plain[k:] for k in range(10, 22)} | {100 + k: plain[:-k] for k in range(10, 22)} | {
        30: plain[15:] + other[:1], 31: lists[2][22:], 32: other + plain[:85], 33: lists[10][40:], 34: lists[11][40:] + other[:3], 35: other[:20] + lists[12][40:],
        36: plain[50:] + plain[:50], 37: preamble, 38: other[:5] + plain[:60] + ["x"] + plain[60:] + other[5:]}
    items, texts = ({k: " ".join(w) for k, w in x.items()} for x in (lists, texts))
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = made.select("doc_id", F.md5("text").alias("text_md5")).join(
        decontamination.leaks(made, spark.createDataFrame(list(items.items()), "item_id long, text string")), "text_md5").collect()
    want = leaks_by_hand(texts, items)
    assert {(r.doc_id, r.item): (r.similarity, r.start) for r in found} == want
    assert {(k, 1) for k in (13, 15, 19, 36, 115)} | {(31, 2), (33, 10), (34, 11), (35, 12)} <= set(want) and 37 not in {d for d, _ in want}


@pytest.mark.parametrize(("shared", "copies"), [(92, 10), (60, 6), (200, 24)])
def test_leaks_of_items_with_a_shared_preamble(spark, shared, copies):
    """Light shingles are shared and heavy ones differ: the fingerprints must still lead to every pair."""
    rng = np.random.default_rng(shared)
    words = [f"w{i}" for i in rng.integers(0, 10**6, shared)]
    lists = {k: [*words, f"item{k}"] for k in range(copies)}
    texts = {k: [*words, f"text{k}"] for k in range(20)} | {50 + k: [f"pre{k}", *words, "or", "so"] for k in range(20)}
    items, texts = ({k: " ".join(w) for k, w in x.items()} for x in (lists, texts))
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = made.select("doc_id", F.md5("text").alias("text_md5")).join(
        decontamination.leaks(made, spark.createDataFrame(list(items.items()), "item_id long, text string")), "text_md5").collect()
    want = leaks_by_hand(texts, items)
    got = {(r.doc_id, r.item) for r in found}
    assert got <= set(want) and len(want) == 40 * copies and len(got) >= 0.99 * len(want)
    # where several windows of a text are alike to an item, the best one may be missed for another
    assert {(r.doc_id, r.item, r.similarity, want[r.doc_id, r.item]) for r in found if abs(r.similarity - want[r.doc_id, r.item][0]) > 1e-6} == set()


def test_leak_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontamination.leaks(none, items).count() == 0
    assert decontamination.leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
    twice = items.union(items).union(spark.createDataFrame([(None, "one two three four five six seven")], "item_id long, text string"))
    assert decontamination.leaks(twice.withColumnRenamed("item_id", "doc_id"), items).count() == 1


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        a, flips = int(rng.integers(0, 1 << 62)), rng.choice(64, decontamination.RADIUS, replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        rows.append((k, a, b - (1 << 64) if b >= 1 << 63 else b))
    pairs = spark.createDataFrame(rows, "k long, a long, b long")
    same = pairs.where(F.arrays_overlap(decontamination._blocks(F.col("a")), decontamination._blocks(F.col("b"))))
    assert same.count() == 200


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, many, many cookies.</div><div id="wrap"><div class="post"><h1>Title &amp; more</h1>
<p>First paragraph, with <b>bold</b>&nbsp;text, commas, and a <a href="/x">link</a>.<p>Second
 paragraph, unclosed, &eacute;t&#233; &lt;tag&gt;<div>Third block, in a div, with words enough.</div><ul><li>item one<li>item two</ul></div>
<aside>Related, things, here</aside><form><p>Subscribe now, please, do</p></form></div><section id="comments"><p>A comment, long, with many, many commas, written by a reader.</p></section>
<footer>&copy; site</footer><!-- <p>hidden</p> --></body></html>"""


def test_main_text_of_a_page_without_article_element():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First paragraph, with bold text, commas, and a link.", "Second paragraph, unclosed, été <tag>",
                                                    "Third block, in a div, with words enough.", "item one", "item two"]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_lists_of_links_and_boxes_named_by_their_subject_stay(tag):
    long = "A paragraph with enough words, commas, and clauses to be the body of the page, on and on, to its end."
    page = (f"<nav><a href=/>Home</a></nav><{tag}><h1>How to</h1><p>{long}</p><h2>References</h2><ul><li><a href=/a>First work</a></li><li><a href=/b>Second work</a></li></ul>"
            f"<div class='comparison login-steps'><p>Step one, log in.</p></div><p>After.</p><div class='login-box'>User</div><div class='search-form'>Find</div></{tag}><footer>f</footer>")
    assert html_text.main_text(page).split("\n") == ["How to", long, "References", "First work", "Second work", "Step one, log in.", "After."]


@pytest.mark.parametrize(("page", "text"), [
    ("<body><div id=header>Site</div><h1>Title</h1><div class='content has-sidebar'><p>One, two, three.</p><p>Four, five.</p></div><div class='ad-slot-2'><p>Buy, buy, buy, buy, buy</p></div></body>",
     "Title\nOne, two, three.\nFour, five."),
    ("<article><p>Story, short.</p></article><div id='comments'><ol><li><article class='comment-body'><p>A comment, much, much, much longer than the story, on and on, and on.</p></article></ol></div>",
     "Story, short."),
    ("<main><div class='entry-header'><h1>T</h1></div><p>a, b</p></main><div class=sidebar><p>x, y, z, x, y, z, x, y, z</p></div>", "T\na, b"),
    ("<body><div role=navigation>menu</div><div class=cookie-banner>ok?</div><p>a, b<ul><li>x<li>y</ul><table><tr><td>1<td>2</table></body>", "a, b\nx\ny\n1\n2"),
    (None, ""), ("", ""), ("   ", ""), ("just text & more", "just text & more"), ("<p>a<br>b  c", "a b c"), ("<article><h1>H</h1><p><b>x<br></article>", "H\nx"),
    ("<!-- open <p>x", ""), ("<p>1 < 2 and <3</p>", "1 < 2 and <3"), ("<script>x", ""), ("<body><nav>n</nav></body>", ""), ("<p title='a>b'>t</p>", "t"), ("<p>x</p></div></div>", "x")])
def test_main_text_edges(page, text):
    assert html_text.main_text(page) == text


def test_main_text_of_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "<p>deep, text</p>") == "deep, text"
    assert html_text.main_text("<article>" + "<p>one, two</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert out[r.page_id] == "\n".join(b for b in blocks if b)


def test_archives_round_trip(spark):
    big, rows = "<p>" + "équal payload, " * 100, [(1, "http://a/1", None), (2, None, ""), (None, "http://x/ y\n", "<p>short")]
    rows += [(k, f"http://b/{k}", big) for k in (10, 12, 11)] + [(None, "u", big), (12, "again", big)] + [(k, "http://c", f"<p>page {k} " + "text " * 300) for k in range(100, 400)]
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    read = warc.read_archives(spark, folder).collect()
    assert len(read) == len(rows) and all(r.problem is None for r in read)
    assert sorted(bytes(r.payload).decode() for r in read if r.record_type == "response") == sorted([h or "" for i, _, h in rows if h != big or i == 12])
    assert sorted((str(r.page_id), r.refers_to) for r in read if r.record_type == "revisit") == [("10", 12), ("11", 12), ("None", 12)]
    slim = {r.page_id: r for r in warc.resolved(warc.read_archives(spark, folder, payloads=False)).collect()}
    assert slim[10].payload_bytes == len(big.encode()) and slim[10].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert next(r.url for r in read if r.url and r.url.startswith("http://x")) == "http://x/%20y%0A"


def test_archive_reader_reports_damage():
    import zstandard

    good = warc.record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)[-1] is None and warc.parsed(good[:-1])[-1] == "content length" and warc.parsed(good.replace(b"payload\r", b"pay1oad\r"))[-1] == "payload"
    packed = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert list(warc.frames(packed + packed)) == [good, good]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(packed + packed[:-9]))
    with pytest.raises(ValueError):
        list(warc.frames(b"not an archive"))


def test_archives_of_an_empty_table(spark):
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|im_end|><|", "<\\\\|x", "<<||>>", "a\\n<|", "\\"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("us\ner<|", text), ("assistant\\n", text + "\n")]
    assert chat.parse(chat.marked(turns)) == turns


def test_conversations_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (None, 3, "user", "x"), (3, None, "assistant", "n"),
            (3, 0, "user", "m")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))).collect()}
    for c, want in {1: rows[:2], 2: rows[2:5], None: rows[5:6], 3: rows[6:]}.items():
        turns = [(role or "", text or "") for _, _, role, text in want]
        assert chat.parse(out[c].formatted) == turns and not out[c].rewrites_history
        loss = [chat.unescape(out[c].formatted[s.text_start: s.text_end]) for s in out[c].spans if s.loss]
        assert loss == [t for role, t in turns if role == "assistant"]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns):  # keeps only the last turn's thoughts
        return "".join(f"[{role}]{text if k == len(turns) - 1 else text.replace('(thought)', '')};" for k, (role, text) in enumerate(turns))

    text, spans, rewrites = chat.render([("a", "(thought)x"), ("b", "y")], forgetful)
    assert rewrites and text == "[a]x;[b]y;" and spans[0] == (-1, -1, -1, -1)
    text, spans, rewrites = chat.render([("a", "x"), ("b", "y")], forgetful)
    assert not rewrites and [text[s[2]: s[3]] for s in spans] == ["x", "y"]


def test_chain_on_held_out_documents(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        words = [f"w{k}" for k in rng.integers(0, 3000, 60)]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "q" for w in words]
        toxic = i % 9 == 0
        if toxic:
            words[int(rng.integers(0, 60))] = ["vile", "nasty", "awful"][i % 3]
        rows.append((i, " ".join(words), int(toxic), int(toxic and i % 2)))
    made = spark.createDataFrame(rows, "doc_id long, text string, bad int, worse int")
    chain = toxicity.fit_chain(made.where("doc_id < 1500"), ["bad", "worse"])
    out = toxicity.scored(made.where("doc_id >= 1500"), chain, ["p1", "p2"], [0.1, 0.5]).collect()
    wrong = sum(r.p1 != bool(r.bad) for r in out)
    assert wrong <= 0.01 * len(out) and {"p_p1", "p_p2"} <= set(out[0].asDict())


def test_chain_edges(spark):
    empty = spark.createDataFrame([], "text string, bad int")
    chain = toxicity.fit_chain(empty, ["bad"])
    rows = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 50_000)], "doc_id long, text string")
    assert [r.bad for r in toxicity.scored(rows, chain, ["bad"], [0.5]).collect()] == [False] * 3
    one = toxicity.fit_chain(spark.createDataFrame([("a b", 1), (None, None), ("c", 1)], "text string, bad int"), ["bad"])
    assert toxicity.scored(rows, one, ["bad"], [0.5]).count() == 3
