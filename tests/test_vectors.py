"""Exact and approximate vector search, lexical search in place and by joins, pluggable models."""

import random
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import retrieval as R
from corpusgraph.operators import vectors as V
from corpusgraph.plans import registered
from corpusgraph.plans import retrieval_queries as queries

QUERIES = registered()[0]


def by_hand(vectors, asked, k):
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    unit = lambda v: np.array(v, float) / (np.linalg.norm(np.array(v, float)) or 1.0)
    vectors = [(i, unit(v)) for i, v in vectors if i is not None and good(v)]
    out = []
    for q in {q for q, _ in asked if q is not None}:
        near = sorted((round(1 - float(unit(a) @ v), 9), i) for x, a in asked if x == q and good(a) for i, v in vectors if len(v) == len(a))
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(spark, vectors, asked, k):
    v = spark.createDataFrame([(i, x, "x") for i, x in vectors], "chunk_id long, embedding array<float>, unit string")
    q = spark.createDataFrame([(i, x, 1) for i, x in asked], "query_id long, embedding array<float>, part int")
    return V.vector_search_many(v, q, k)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 7)) for r in df.collect())


def odd_vectors():
    rng = np.random.default_rng(2)
    f = lambda n: [float(x) for x in np.float32(rng.normal(size=n))]
    vectors = [(i, f(4)) for i in range(300)] + [(i, f(3)) for i in range(300, 340)]
    vectors += [(i, vectors[0][1]) for i in range(900, 930)] + [(7, f(4)), (7, vectors[7][1])]  # ties, an id given again
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf"), 0.0, 0.0, 0.0]), (None, f(4)), (404, []), (405, [0.0] * 4)]
    asked = [(i, f(4)) for i in range(20)] + [(30, f(3)), (31, vectors[0][1]), (32, None), (33, [None] * 4), (None, f(4)), (34, [0.0] * 4), (35, f(9)), (36, f(4)), (36, f(4))]
    return vectors, asked


@pytest.mark.parametrize("bytes_", [V.BROADCAST_BYTES, 0])
def test_exact_search(spark, monkeypatch, bytes_):
    monkeypatch.setattr(V, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "QUERY_ROWS", 4)
    monkeypatch.setattr(V, "GROUP_BLOCKS", 3)
    vectors, asked = odd_vectors()
    for k in (1, 12, 1000):
        assert rows(found(spark, vectors, asked, k)) == [(q, r, i, round(d, 7)) for q, r, i, d in by_hand(vectors, asked, k)]
    assert rows(found(spark, [], asked, 3)) == [] == rows(found(spark, vectors, [], 3))


def test_no_join_on_a_constant(spark, monkeypatch):
    """Neither way joins vectors and queries by their length alone."""
    vectors, asked = odd_vectors()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: found(spark, vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan()
        monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
        assert [x.split("[")[1].count("#") for x in plan().split("\n") if "Join" in x] == [3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def recall(index, v, q, k=10):
    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(V.vector_search_many(v, q, k))
    return len(exact & pairs(V.search_lists(index, q, k))) / len(exact)


def test_inverted_lists_of_the_registered_queries(spark):
    """Recall of 0.9 on both tables, every vector under one list; on texts, which gather in groups, few vectors are compared."""
    d = "/root/testdata/sf0.01"
    v, q = queries.vectors(spark, d), queries.vector_queries(spark, d)
    index = V.build_lists(v, 64)
    assert index.table.count() == v.count() == index.table.select("key").distinct().count()
    assert recall(index, v, q) >= 0.9
    docs = R.hashed_embeddings(queries.corpus(spark, d), "chunk_id", "content")
    asked = docs.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    index = V.build_lists(docs, 64)
    assert recall(index, docs, asked) >= 0.9
    assert V.probed_share(index, asked).agg(F.avg("share")).first()[0] < 0.6


def test_lists_of_clusters(spark):
    """Under a tenth of the vectors are candidates where vectors gather; a hot group of equal vectors lies in many tasks."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(80, 16))
    x = np.concatenate([centers[rng.integers(0, 80, 4000)] + rng.normal(size=(4000, 16)) * 0.15, np.repeat(centers[:1], 2000, 0)])
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    q = v.filter("chunk_id % 50 = 0 and chunk_id < 4000").withColumnRenamed("chunk_id", "query_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        index = V.build_lists(v, 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.recall >= V.RECALL and recall(index, v, q) >= 0.9
    assert V.probed_share(index, q.filter("query_id > 0")).agg(F.percentile("share", F.lit(0.5))).first()[0] < 0.1
    everything = V.search_lists(index, q, 10, probes=len(index.centroids))
    assert rows(everything) == rows(V.vector_search_many(v, q, 10))
    hot = index.table.groupBy("part").count().orderBy(F.desc("count")).first()["part"]
    assert index.table.filter(F.col("part") == hot).select(F.input_file_name()).distinct().count() > 1


def test_lists_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, embedding array<float>")
    assert V.search_lists(V.build_lists(none, 2), q, 3).collect() == []
    one = V.build_lists(spark.createDataFrame([(5, [1.0, 1.0]), (None, [1.0, 0.0])], none.schema), 2)
    assert [(r["query_id"], r["chunk_id"]) for r in V.search_lists(one, q, 3).collect()] == [(1, 5)]


def test_queries_of_lists_beyond_the_broadcast(spark, monkeypatch, sf_dir):
    v, q = queries.vectors(spark, sf_dir), queries.vector_queries(spark, sf_dir)
    index = V.build_lists(v, 64)
    want = rows(V.search_lists(index, q, 5))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    assert rows(V.search_lists(index, q, 5)) == want


def test_word_places(spark):
    """Counts in place equal a plain count; nulls and blanks are [empty]."""
    import hashlib

    texts = [(1, "One two ONE\tthree"), (2, None), (3, "  "), (4, "ä " * 500 + "b"), (None, "x")]
    got = {r["k"]: r["embedding"] for r in V.hashed_embeddings(spark.createDataFrame(texts, "k long, t string"), "k", "t", 16).collect()}
    for i, t in texts:
        x = np.zeros(16)
        for w in (t if t and t.strip() else "[empty]").lower().split():
            x[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % 16] += 1
        assert np.allclose(got[i], x / np.linalg.norm(x))


@pytest.mark.parametrize("limit", [R.BROADCAST_TERMS, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_both_ways(spark, monkeypatch, limit, kind):
    """In place and by joins: words of most chunks, ties, unscored chunks, chunks and questions without words, nulls."""
    from tests.test_brute import bm25_by_hand

    monkeypatch.setattr(R, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(R, "STEP", 64)
    rng = np.random.default_rng(8)
    chunks = [(f"c{i:03}" if kind == "string" else i, " ".join("abcdefghijkl"[int(x)] for x in np.minimum(11, rng.geometric(0.35, int(rng.integers(0, 9))) - 1))) for i in range(90)]
    chunks += [("d" if kind == "string" else 500, None), ("e" if kind == "string" else 501, "a a a l")]
    asked = {1: "a", 2: "zz", 3: "l k", 4: "a b c a", 5: "", 6: "a l j"}
    df = spark.createDataFrame(chunks, f"chunk_id {kind}, content string")
    qs = spark.createDataFrame([*asked.items(), (7, None)], "query_id long, question string")
    for k in (1, 7, 200):
        got = R.bm25_search(df, qs, k).collect()
        for q, text in {**asked, 7: ""}.items():
            assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == bm25_by_hand(chunks, text, k)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return lambda rows: [[3.0 * len(r), 4.0 * len(r)] for r in rows]

    df = spark.range(400).selectExpr("id", "repeat('x', cast(id % 7 as int)) as content").repartition(24)
    model = R.Loaded(load)
    for _ in range(6):
        got = R.embed(df, model, 2).collect()
        assert all(np.allclose(r["embedding"], [0.6, 0.8]) for r in got)
    pids = [x.split("-")[0] for x in os.listdir(folder)]
    assert len(pids) == len(set(pids)) and len(pids) < 6 * 24  # a session's pool may hold dozens of workers, but each loads once


def test_pair_scores_of_a_model(spark):
    def model(pairs):
        if any(c == "bad" for _, c in pairs):
            raise ValueError("no")
        return [float("nan") if c == "nan" else len(q) + 0.1 * len(c) for q, c in pairs]

    rows_ = [(1, 1, "q", "aaaa"), (1, 2, "q", "a"), (1, 3, "q", "bad"), (1, 4, "q", None), (1, 5, None, "aaaaaaaaaaaa"), (1, 6, "q", "nan")]
    df = spark.createDataFrame(rows_, "query_id long, ordinal int, question string, content string").coalesce(1)
    got = {r["ordinal"]: r["s"] for r in df.withColumn("s", R.model_score(model)).collect()}
    assert got[3] is None and got[6] is None and [round(got[i], 3) for i in (1, 2, 4, 5)] == [1.4, 1.1, 1.0, 1.2]
    assert [r["ordinal"] for r in R.rerank(df, R.model_score(R.Loaded(lambda: model)), 2, 1.05).orderBy("rank").collect()] == [1, 5]


def test_compounds_by_the_fewest_tokens():
    """Every way to part the words, by hand: the fewest tokens, then the longest first ones."""
    import itertools

    from corpusgraph.functions.segment import Compounds

    known = {"a b", "b c", "c d e", "a b c", "d e", "e f g h", "A  A"}
    trie, joined = Compounds(known), {k.lower().replace("  ", " ") for k in known}

    def ways(words):
        if not words:
            yield []
        for k in range(1, len(words) + 1):
            if k == 1 or " ".join(words[:k]) in joined:
                for rest in ways(words[k:]):
                    yield [words[:k], *rest]

    for n in range(7):
        for words in itertools.product("abcde", repeat=n) if n < 5 else [tuple("abcdefgh"[:n]), tuple("aabcdefgh"), tuple("cdefgh")]:
            best = min(ways(list(words)), key=lambda w: (len(w), [-len(x) for x in w]))
            assert trie.join(list(words)) == ["_".join(x) for x in best]


def test_a_compound_is_one_term(spark):
    from corpusgraph.functions.segment import segmenter

    chunks = spark.createDataFrame([(1, "Sinh viên học"), (2, "sinh vật và viên đá"), (3, None), (4, "giáo viên")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "SINH VIÊN"), (2, "viên")], "query_id long, question string")
    cut = segmenter(spark, ["sinh viên", "giáo viên", "sinh vật"])
    got = {(r["query_id"], r["chunk_id"]) for r in R.bm25_search(chunks, asked, 4, tokens=cut).collect() if r["score"] > 0}
    assert got == {(1, 1), (2, 2)}
    tokens = {r["chunk_id"]: r["t"] for r in chunks.select("chunk_id", cut(F.col("content")).alias("t")).collect()}
    assert tokens == {1: ["sinh_viên", "học"], 2: ["sinh_vật", "và", "viên", "đá"], 3: None, 4: ["giáo_viên"]}


def test_compounds_are_joined_without_a_bound(spark, monkeypatch):
    """As the segmenter joins them, for repeated, null, empty and one-word texts, also where the bit table is full and the compounds are more than a segmenter may hold."""
    from corpusgraph.functions import segment

    rng = random.Random(2)
    texts = [None, "", " ", "a", "A  b"] + [" ".join(rng.choices("abcdef", k=rng.randrange(2, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts + texts[:9])], "id long, t string")
    known = [f"{a} {b}" for a, b in ("ab", "bc", "cc", "fa", "de")]
    want = sorted(((r["id"], r["w"] and " ".join(r["w"])) for r in df.select("id", segment.segmenter(spark, known)(F.col("t")).alias("w")).collect()), key=str)
    monkeypatch.setattr(segment, "MOST_COMPOUNDS", 3)
    for bits in (1 << 28, 1 << 15):
        monkeypatch.setattr(segment, "MOST_BITS", bits)
        more = [] if bits > 1 << 15 else [f"x{i} y" for i in range(100_000)]
        got = segment.join_compounds(df, "t", spark.createDataFrame([(c,) for c in known + more], "compound string"))
        assert sorted(((r["id"], r["t"] or (None if r["t"] is None else [])) for r in got.collect()), key=str) == want


def test_segmented_search(spark, sf_dir):
    """The registered query against BM25 by hand over joined words."""
    from corpusgraph.functions.segment import Compounds
    from corpusgraph.plans.ingest_queries import compounds
    from tests.test_brute import bm25_by_hand

    trie = Compounds([r["compound"] for r in compounds(spark, sf_dir).collect()])
    join = lambda t: " ".join(trie.join((t or "").lower().split()))
    chunks = [(r["chunk_id"], join(r["content"])) for r in queries.corpus(spark, sf_dir).collect()]
    assert sum("_" in t for _, t in chunks) > 50
    got = QUERIES["s20_segmented_search"](spark, sf_dir).collect()
    for q in queries.questions(spark, sf_dir).collect():
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q["query_id"]] == bm25_by_hand(chunks, join(q["question"]), 10)
