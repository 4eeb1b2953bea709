import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import topk


@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5), st.integers(1, 8))
@settings(max_examples=150, deadline=None)
def test_bounds_keep_the_best(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    lists, queries = rng.integers(-6, 6, (n, dims)).astype(float), rng.integers(-6, 6, (3, dims)).astype(float)
    for q, (found, got) in zip(queries, topk.nra_top(topk.SortedLists(lists), queries, k), strict=True):
        scores = lists @ q
        need = np.sort(scores)[::-1][min(k, n) - 1]
        assert set(np.flatnonzero(scores >= need)) <= set(found.tolist()) and (got == scores[found]).all()


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    lists = rng.integers(0, 10, (2000, 3)).astype(float)
    lists[:5] += 1000
    found = topk.nra_top(topk.SortedLists(lists), np.ones((1, 3)), 5)[0][0]
    assert set(range(5)) <= set(found.tolist()) and len(found) < 100


def by_hand(rows, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in good if i is not None and i % 100 == 0}):
        for qv in (v for i, v in good if i == q):
            scores = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i is None, i or 0) for i, v in good if i != q and len(v) == len(qv)))[:k]
            out |= {(q, r, None if n else i, -s) for r, (s, n, i) in enumerate(scores, 1)}
    return out


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(450)]
    rows += [(i, rows[7][1]) for i in range(1000, 1040)] + [(i, rows[100][1]) for i in range(1100, 1130)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2003, [float("inf")] * 4), (None, [9.0, 9.0, 9.0, 9.0]), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2200, []), (2201, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    assert {tuple(r) for r in topk.embeddings_top_k(df).collect()} == by_hand(rows)


def test_empty(spark):
    assert topk.embeddings_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_rows_of_a_query(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(101, 160)]
    same = [5.0, 5.0, 5.0, 5.0]
    rows += [(100, same)] * 2 + [(200, same)] * 15 + [(i, same) for i in range(1, 13)]  # a query's own rows among equal vectors
    rows += [(300, [float(i), 1.0, 0.0, 0.0]) for i in range(20, 34)]  # one id, many vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.embeddings_top_k(df).collect()}
    want = by_hand(rows)
    assert {r for r in got if r[0] != 300} == {r for r in want if r[0] != 300}
    assert sum(r[0] == 300 for r in got) == 10
