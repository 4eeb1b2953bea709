import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import decontam


def by_hand(passage, item):
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, w in enumerate(item, 1):
        for j, v in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (1 if v == w and w > 0 else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=25), st.lists(st.integers(1, 4), min_size=1, max_size=15))
@settings(max_examples=300, deadline=None)
def test_alignment(passage, item):
    score, start, end = decontam.local_alignment(np.array(passage), np.array(item))
    assert score == by_hand(passage, item)
    assert by_hand(passage[start:end], item) == score


def text(rng, n, of=2000):
    return [f"v{int(i)}" for i in rng.integers(0, of, n)]


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    items = [text(rng, int(n)) for n in rng.integers(16, 60, 25)]
    docs, want = [], set()
    for i in range(300):
        words = text(rng, int(rng.integers(0, 300)))
        if i % 3 == 0:
            k = int(rng.integers(len(items)))
            copy = list(items[k])
            for j in range(len(copy)):
                if i % 2 and rng.random() < 0.1:
                    copy[j] = "edited"
            if i % 2:
                copy.insert(len(copy) // 2, "more")
            at = int(rng.integers(len(words) + 1))
            words[at:at] = [w.upper() + "," for w in copy]
            want.add((i, k))
        docs.append((i, " ".join(words)))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], want


def test_planted(spark, planted):
    docs, items, want = planted
    got = decontam.leaks(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    exact = [r for r in got if r["doc_id"] % 2 == 0]
    assert all(r["score"] == 1 and r["n_words"] == len(dict(items)[r["item_id"]].split()) for r in exact)


def test_several_passes(spark, planted, monkeypatch):
    docs, items, want = planted
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 200)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, i).collect()} == want
    kept = {r["doc_id"] for r in decontam.drop_leaks(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in want}


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "a b"), (4, "")], "item_id long, text string")
    rows = [(None, item), (5, None), (6, ""), (7, (item + " x") * 3000), (8, "a b"), (9, item), (9, item)]
    got = sorted((str(r["doc_id"]), r["item_id"], r["score"], r["n_places"] > 0) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [("7", 1, 1.0, True), ("9", 1, 1.0, True), ("9", 1, 1.0, True), ("None", 1, 1.0, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.leaks(empty, items).collect() == []
    assert decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).collect() == []
