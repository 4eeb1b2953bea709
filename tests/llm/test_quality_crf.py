import itertools
import zlib

import numpy as np

from corpusgraph.llm import quality_crf as Q
from corpusgraph.llm.queries import QUERIES


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(5)
    lengths = [1, 4, 2, 6]
    scores, moves = rng.normal(size=sum(lengths)) * 2, rng.normal(size=(2, 2))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    got, expected = Q.forward_backward(scores, chain, moves)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        s, weight, own, moved = scores[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(a * b for a, b in zip(s, y, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            weight += w
            own += w * np.array(y)
            for a, b in itertools.pairwise(y):
                moved[a, b] += w
        want += list(own / weight)
        pairs += moved / weight
        at += n
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_lines_and_neighbours():
    lines = Q.Lines.of([b"One two\n\n  \nONE one one\rx\nOne two", b"", b"###", "Ä\n|a|b|".encode()])
    assert lines.text.tolist() == [0, 0, 0, 2, 3, 3] and lines.size.tolist() == [7, 13, 7, 3, 2, 5]
    at = list(Q.FEATURES).index("line seen before")
    assert lines.bins[:, at].tolist() == [0, 0, 1, 0, 0, 0] and lines.bins.max() < Q.BINS - 1
    places = Q.feature_places(lines.bins, lines.text) % Q.BINS
    width, none = len(Q.FEATURES), Q.BINS - 1
    assert (places[0, :width] == none).all() and (places[1, :width] == lines.bins[0]).all() and (places[2, 2 * width :] == none).all() and (places[3, :width] == none).all()


def test_neighbours_change_a_lines_label():
    """One odd line among good ones is less bad than among bad ones, and marginals of a good document's lines stay apart."""
    good, bad = b"Some words stand here, as they do in prose.", b"### $$$ ||| ### $$$ |||"
    sample = [(1, Q.Lines.of([b"\n".join([good] * n)]).bins) for n in (1, 3, 5, 8)] + [(0, Q.Lines.of([b"\n".join([bad] * n)]).bins) for n in (1, 3, 5, 8)]
    model = Q.train(sample, 0.5)
    _, p = Q.line_marginals(model, [b"\n".join([good, good, bad, bad, bad, good, good]), bad, good])
    assert p[0] > 0.5 > p[3] and p[7] < 0.3 < 0.7 < p[8]
    assert model.moves[0, 0] + model.moves[1, 1] > model.moves[0, 1] + model.moves[1, 0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op12_quality"](spark, d).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == docs
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.97


def test_odd_rows(spark):
    """Null ids, texts and labels, blank and very long texts, repeated rows and clashing columns; scores do not hang on other columns."""
    rng = np.random.default_rng(1)
    prose = lambda: "\n".join(" ".join("word" + "abc"[int(x)] for x in rng.integers(0, 3, 12)) + "." for _ in range(4))
    junk = lambda: "\n".join("### " * int(rng.integers(3, 9)) for _ in range(4))
    texts = [prose() if i % 2 else junk() for i in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (502, " \n\t\n", 1), (None, texts[1], 1), (1, texts[1], 1), (503, ("Good words here. " * 6 + "\n") * 20_000, 1), (504, "x" * 3_000_000, 1)]
    labels = [(i, i % 2) for i in range(120)] + [(None, 0), (3, None), (4, 7), (9999, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.score_held_out(docs, marks).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    prior = {s for i in (500, 501, 502) for s in by_id[i]}
    assert len(prior) == 1 and 0.3 < min(prior) < 0.7
    assert by_id[None] == by_id[1] and len(by_id[1]) == 1
    assert all((min(by_id[i]) >= 0.3) == bool(i % 2) for i in range(120)) and min(by_id[503]) > 0.5
    assert {r["predicted"] for r in got} == {0, 1}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["doc_id"], r["score"]) for r in Q.score_held_out(docs, none).collect()} == {(1, 0.5), (2, 0.5)}
    assert Q.score_held_out(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in Q.score_held_out(docs, one).collect())


def test_lines_of_a_score(spark):
    docs = spark.createDataFrame([(1, "One line.\n\nTwo."), (2, "")], "doc_id long, text string")
    model = Q.Model(np.zeros((3, len(Q.FEATURES), Q.BINS)), 1.0, np.eye(2), 0.25)
    got = {r["doc_id"]: r for r in Q.score(docs, model, with_lines=True).collect()}
    assert [x["bytes"] for x in got[1]["lines"]] == [9, 4] and got[2]["lines"] == [] and got[2]["score"] == 0.25
    assert abs(got[1]["score"] - sum(x["bytes"] * x["good"] for x in got[1]["lines"]) / 13) < 1e-12
