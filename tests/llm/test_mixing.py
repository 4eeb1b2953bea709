from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import mixing


def targets_by_hand(sizes, share=1.5):
    """Deal the budget by weight, again and again, until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2 * sizes[s] for s in above}


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
@settings(max_examples=150, deadline=None)
def test_the_rest_is_fitted_exactly(hist, budget):
    lengths, counts = list(hist), list(hist.values())
    take = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    got = sum(n * t for n, t in zip(lengths, take, strict=True))
    assert got <= budget
    even = [c * budget // max(1, sum(n * k for n, k in hist.items())) for c in counts] if budget < sum(n * k for n, k in hist.items()) else counts
    base = sum(n * t for n, t in zip(lengths, even, strict=True))
    sums = {base}
    for n, c, e in zip(lengths, counts, even, strict=True):
        sums = {s + n * k for s in sums for k in range(c - e + 1)}
    assert got == max(s for s in sums if s <= budget)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["a", "b", None, "Z", "c"][i % 5] if i % 3 else "hot") for i in range(600)]
    rows += [(7, None, "a"), (8, "", None), (None, "x y", "b"), (9, "two words", "a"), (9, "two words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target")
    got = [r.asDict() for r in mixing.mix_to_targets(docs).collect()]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = targets_by_hand(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = [r.asDict() for r in mixing.mix_to_targets(docs.repartition(5)).collect()]
    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_long_groups_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    docs = spark.range(3000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 2900, 'x', 'y') as source")
    got = mixing.mix_to_targets(docs).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["target"] - r["sum(taken)"]) <= 3 for r in got)


def test_empty(spark):
    assert mixing.mix_to_targets(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert mixing.mix_to_targets(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()["taken"] == 0
