"""The pipeline against a version that does every stage by brute force, and the registration of the queries."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from test_documents_and_pages import components_by_hand, leaks_by_hand
from test_rules_and_spans import ASSIGN, base_counts, check_packing, whole_ids

import corpus_pipeline
from tesserine.llm import catalog, quality

SF = "/root/testdata/sf0.001"


def kept_by_hand(rows):
    """Rows (id, text, lang, source) that the quality rules keep, with plain NumPy."""
    vectors = {}
    for i, text, lang, source in rows:
        n, _, _, _, repeats = base_counts(text)
        if n >= 10 and 100 * repeats <= 20 * n:
            vectors[i] = (lang, source, np.asarray(quality.measure(text or "")[5]))
    groups = collections.Counter((lang, source) for lang, source, _ in vectors.values())
    small = collections.Counter()
    for (lang, _), n in groups.items():
        small[lang] += n if n < quality.LEAST_ROWS else 0
    strata = collections.defaultdict(list)
    for i, (lang, source, _) in vectors.items():
        own, language = groups[lang, source] >= quality.LEAST_ROWS, small[lang] >= quality.LEAST_ROWS
        strata[("group", lang, source) if own else ("language", lang) if language else ("rest",)].append(i)
    kept, floor = set(), np.square(quality.FLOOR)
    for ids in strata.values():
        x = np.array([vectors[i][2] for i in ids])
        q1, mean, q3 = np.percentile(np.round(x, 3), [25, 50, 75], axis=0)
        precision = np.diag(1 / np.square(np.maximum((q3 - q1) / 1.349, quality.FLOOR)))

        def distances(mean, precision, x=x):
            return np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)

        limit, factor = quality._consistency(quality.REWEIGHTED)
        for share, c in [(quality.KEPT, quality._consistency(quality.KEPT)[1])] * quality.STEPS + [(None, factor)]:
            d = distances(mean, precision)
            if share is None:
                near = d <= limit
            else:  # whole distance bins up to the share
                bins = np.clip(np.floor(np.log2(d + 1e-9) * quality.PER_OCTAVE) - quality.LOWEST, 0, quality.BINS - 1)
                near = bins <= np.sort(bins)[math.ceil(len(d) * share) - 1]
            mean = x[near].mean(axis=0)
            precision = np.linalg.inv(np.cov(x[near].T, bias=True) * c + np.diag(floor))
        kept |= {i for i, d in zip(ids, distances(mean, precision), strict=True) if d <= quality.CUTOFF}
    return kept


def masked_by_hand(docs):
    """Texts with the spans of values that one owner holds masked; docs: id -> (text, source)."""
    spans, owners = collections.defaultdict(list), collections.defaultdict(set)
    for i, (text, source) in docs.items():
        found = [(m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
        for start, end, value in found:
            spans[i].append((start, end, value))
            owners[value].add(source)
    out = {}
    for i, (text, _) in docs.items():
        made, at = "", 0
        for start, end, value in sorted(spans[i]):
            if len(owners[value]) == 1:
                if start >= at:
                    made += text[at:start] + "[secret]"
                at = max(at, end)
        out[i] = made + text[at:]
    return out


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    now, frames = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, SF), f"test-{name}")
        frames.append(now)
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").distinct().collect()} for f in frames]
    want = kept_by_hand([(i, r.text, r.lang, r.source) for i, r in rows.items()])
    assert ids[0] == want
    group, _ = components_by_hand({i: rows[i].text for i in want}, 5, 80)
    want = set(group.values())
    assert ids[1] == want
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want -= {d for d, _ in leaks_by_hand({i: rows[i].text for i in want}, items)}
    assert ids[2] == want and len(want) < len(rows)
    texts = masked_by_hand({i: (rows[i].text, rows[i].source) for i in want})
    got = {r.doc_id: r for r in frames[3].collect()}
    assert {i: r.text for i, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())
    token_ids = dict(zip(texts, whole_ids(list(texts.values())), strict=True))
    pieces = frames[4].collect()
    check_packing(pieces, lambda r: token_ids[r.doc_id], 4096)
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in pieces) == sorted(
        (i, k, at, min(4096, len(t) - at)) for i, t in token_ids.items() for k, at in enumerate(range(0, len(t), 4096)))
    assert all(zlib.crc32(np.asarray(token_ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces)


def test_stages_take_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 9, "xx", None, 45)], docs.schema)
    for start in (docs.limit(0), odd):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.saved(stage(spark, now, SF), f"test-{name}")
        assert now.count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op3_secret_ownership", "op4_simhash_windows", "op9_interleaved_shards"])
def test_native_queries_run_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
