import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import substring


def by_hand(rows, window):
    """Rows in document order: (doc, text) -> (words, removed, sha)."""
    seen, out = set(), []
    for text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return out


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=8), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_automaton(strings, least):
    automaton, seen = substring.SuffixAutomaton(), set()
    for s in strings:
        want = []
        for e in range(len(s)):
            if e + 1 >= least:
                w = tuple(s[e - least + 1 : e + 1])
                if w in seen:
                    want.append(e)
                seen.add(w)
        assert automaton.feed(s, least) == want


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{i}" for i in range(400)])
    passages = [" ".join(rng.choice(vocab, int(k))) for k in rng.integers(10, 60, 12)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocab, int(rng.integers(0, 40))))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(len(passages)))].split()
            if rng.random() < 0.3:
                p[int(rng.integers(len(p)))] = "edited"
            parts += [" ".join(p), " ".join(rng.choice(vocab, int(rng.integers(0, 8))))]
        out.append("\n".join(parts))
    return out


@pytest.mark.parametrize("strings", [2000, 3])
def test_corpus(spark, monkeypatch, strings):
    monkeypatch.setattr(substring, "AUTOMATON_STRINGS", strings)
    rows = corpus(1, 150)
    rows[5:9] = [None, "", rows[4], rows[4] + " " + rows[4]]
    rows += ["ab " * 300, "x y " * 200, "ab " * 25, "nb sp x Ab", " ".join(r for r in rows[10:50])]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(rows)], "doc_id long, text string, start string, n int")
    got = sorted(tuple(r) for r in substring.drop_repeats(docs.repartition(7), 20).collect())
    assert got == [(i, *w) for i, w in enumerate(by_hand(rows, 20))]


def test_rows_given_twice_and_without_id(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(3, text), (3, text), (None, text), (4, text + " end")]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()))
    assert got == [(False, 3, 0, text), (False, 3, 0, text), (False, 4, 30, "end"), (True, None, 30, "")]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = by_hand([r["text"] for r in rows], 20)
    assert [tuple(r) for r in substring.drop_repeats(docs).orderBy("doc_id").collect()] == [(r["doc_id"], *w) for r, w in zip(rows, want, strict=True)]


def test_empty(spark):
    assert substring.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
