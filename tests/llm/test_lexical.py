import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusgraph.llm import lexical
from corpusgraph.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items}:
        scores = []
        for i, c, n in counts:
            m = 100 - 90 + 90 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, h int, item int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    return sorted((tuple(r) for r in lexical.search(d, q, k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.4)) % 700}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 120))))) for i in range(600)]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 25))))) for i in range(25)]
    return docs, items


def test_against_all_pairs(spark, corpus):
    assert found(spark, *corpus) == by_hand(*corpus)


def test_blocks_and_shuffled_candidates(spark, corpus, monkeypatch):
    """Small blocks, several passes over items, groups of few terms, candidates joined by shuffling."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 20)
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 400)
    monkeypatch.setattr(lexical, "BROADCAST_CANDIDATES", 0)
    assert found(spark, *corpus) == by_hand(*corpus)


def test_odd_rows(spark):
    """Copies, ties, nulls, repeated ids, very long texts, signs alone, other alphabets, items without words."""
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    docs = [(i, "The Quick brown fox") for i in range(40)] + [(5, "quick"), (None, "quick fox"), (None, None), (90, ""), (91, "... !"), (92, long), (93, long + " fox"), (94, "Über ÜBER fox_42"), (95, "a\x00b fox"), (96, "fox " * 3000)]
    items = [(1, "quick FOX"), (1, "quick FOX"), (2, None), (3, ""), (4, "x17 x4999 fox"), (5, "Über 42"), (None, "brown"), (6, "nowhere"), (7, "quick"), (7, "b")]
    assert found(spark, docs, items, 3) == by_hand(docs, [x for x in items if x[1]], 3)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_exclude_and_never_fall_short(spark, corpus):
    """Bounds are at least the scores, and most documents are excluded without a look at their texts."""
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as h", "text")
    asked = lexical.Asked.of([(i, t.encode()) for i, t in items])
    sc = spark.sparkContext
    index = lexical.signatures(d, sc.broadcast(asked)).cache()
    df = Counter(t for _, text in docs for t in set(terms(text)))
    total = sum(len(terms(t)) for _, t in docs)
    weighed = asked.weighed(len(docs), total, {n: df[t.decode()] for t, n in asked.vocab.items()})
    sent = sc.broadcast(weighed)
    bounds = {(r["item"], r["doc_id"]): r["bound"] for r in lexical.not_excluded(index, sent, {}, len(docs)).collect()}
    exact = by_hand(docs, items, len(docs))
    assert all(bounds[(i, doc)] >= s for i, _, doc, s in exact)
    least = {i: min((s, -doc) for j, r, doc, s in exact if j == i and r <= 10) for i, _ in items if sum(x[0] == i for x in exact) >= 10}
    left = lexical.not_excluded(index, sent, {i: (s, -doc) for i, (s, doc) in least.items()}, 10).filter("item in (%s)" % ",".join(map(str, least))).count()
    assert left < 0.2 * len(least) * len(docs)


def test_query_against_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_lexical"](spark, sf_dir).collect()), key=repr) == by_hand(docs, items)
