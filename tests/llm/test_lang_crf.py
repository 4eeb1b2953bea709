import itertools
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import lang_crf


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3))
    total, want, pairs = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(sum(scores[0, t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for t, x in enumerate(path):
            want[t, x] += p
        for a, b in itertools.pairwise(path):
            pairs[a, b] += p
    gamma, expected = lang_crf.forward_backward(scores, np.ones((1, 5), bool), moves)
    assert np.allclose(gamma[0], want / total)
    assert np.allclose(expected, pairs / total)
    padded = np.zeros((1, 8, 3), np.float32)
    padded[:, :5] = scores
    fast = lang_crf._gamma(padded, np.array([[True] * 5 + [False] * 3]), moves.astype(np.float32))
    assert np.allclose(fast[0, :5], want / total, atol=1e-4)


def test_words():
    words = lang_crf.Words.of(["Één TWO, x".encode(), b"", b"12 a-b"])
    assert [bytes(words.data[a:b].astype(np.uint8)).decode() for a, b in zip(words.start, words.end, strict=True)] == ["één", "two", "x", "a", "b"]
    assert words.text.tolist() == [0, 0, 0, 2, 2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_crf.predict_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(int(lang_pred = lang)) a", "count(*) n").first()
    assert got["n"] > 250 and got["a"] > 0.98


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return lang_crf.fit(docs)


def test_code_switching(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    en, de = (docs.filter(f"lang = '{x}' and length(text) > 2000").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    mixed = " ".join(en.split()[:60]) + " " + " ".join(de.split()[:60])
    got = lang_crf.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, with_spans=True).first()
    by = {}
    for s in got["spans"]:
        by[s["lang"]] = by.get(s["lang"], 0) + s["n"]
    assert by["en"] > 45 and by["de"] > 45 and len(got["spans"]) <= 8


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "— …"), (None, "the the of"), (5, "the " * 30000), (5, "the " * 30000), (6, "漢字")]
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in lang_crf.identify(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, score string"), model).collect())
    assert [g[1] for g in got if g[0] in "1234"] == ["und"] * 4
    assert [g for g in got if g[0] == "5"][0] == [g for g in got if g[0] == "5"][1]
    assert all(0 <= g[2] <= 1 for g in got) and len(got) == 8
    assert lang_crf.identify(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_nothing_to_learn_from(spark):
    got = lang_crf.predict_held_out(spark.createDataFrame([(1, "a b", None), (2, "c", None)], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    one = lang_crf.predict_held_out(spark.createDataFrame([(i, "a b", "xx") for i in range(9)], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in one)


def test_memory_does_not_grow_with_the_batch_or_a_text(model):
    """A batch of a megabyte of short texts, and one long text of two megabytes, are labelled in a bounded part of memory."""
    line = "the quick brown fox and the lazy dog, "
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 501, "text": [line * 55] * 500 + [line * 55_000]})
    context = types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x))
    docs = types.SimpleNamespace(columns=["lang", "text"], schema=None, sparkSession=types.SimpleNamespace(sparkContext=context), mapInArrow=lambda f, _: f)
    run = lang_crf.keep_known(docs, model, 0.5)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 501 and peak < 60e6


def test_long_texts_are_labelled_as_a_whole(model, monkeypatch):
    monkeypatch.setattr(lang_crf, "SLICE_BYTES", 1000)
    monkeypatch.setattr(lang_crf, "PART_WORDS", 2 * lang_crf.CHAIN_WORDS)
    texts = ["the of and " * 500, "12 ΑΣ'Α, der die und É " * 300, "漢字 " * 999, "1 " * 999, "— " * 999, "a" * 5000, "short the", "the " * 128 + "x" * 600, "the " * 127 + "x" * 600]
    data = [t.encode() for t in texts]
    names, means = lang_crf.languages(model, data)
    want_names, want_means, _, _ = lang_crf.predict(model, data)
    assert names == want_names and np.allclose(means, want_means, atol=1e-6)
    assert b"".join(lang_crf.whole_chains(data[1])) == texts[1].lower().encode()
