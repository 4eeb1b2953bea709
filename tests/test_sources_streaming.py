"""Files, vector collections, pluggable embedders and the streaming jobs."""

import datetime as dt

from pyspark.sql import functions as F

from corpusgraph.operators import retrieval
from corpusgraph.sources import files
from corpusgraph.streaming import events


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Tïtle")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["filename"]: (r["text"], r["file_type"], r["page_count"]) for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("né", "txt", 1), "b.md": ("# Tïtle", "md", 1)}


def test_eval_json(spark, tmp_path):
    df = spark.createDataFrame([("R1", 3)], "id string, source_count int")
    files.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "set.json").write_text('[{"id": "R1", "user_input": "q", "reference_contexts": ["a"]},\n {"id": "R2", "metrics": {"x": 0.5}}]')
    assert [r["id"] for r in files.read_eval_json(spark, str(tmp_path / "set.json")).orderBy("id").collect()] == ["R1", "R2"]


def test_vector_collection(spark, tmp_path):
    path = str(tmp_path / "vectors")
    frame = lambda rows: spark.createDataFrame(rows, "workspace string, chunk_id string, embedding array<float>")
    files.write_vectors(frame([("a", "1", [1.0, 0.0]), ("a", "2", [0.0, 1.0]), ("b", "3", [1.0, 1.0])]), path)
    files.write_vectors(frame([("a", "2", [5.0, 5.0]), ("a", "4", [2.0, 2.0])]), path)
    assert {r["chunk_id"]: r["embedding"][0] for r in files.read_vectors(spark, path, "a").collect()} == {"1": 1.0, "2": 5.0, "4": 2.0}
    files.write_vectors(frame([("a", "9", [1.0, 2.0, 3.0])]), path)  # another dimension takes the place of the collection
    assert [r["chunk_id"] for r in files.read_vectors(spark, path, "a").collect()] == ["9"]
    assert files.read_vectors(spark, path, "b").count() == 1
    assert files.read_vectors(spark, path, ids=spark.createDataFrame([("3",)], "chunk_id string")).count() == 1


def test_lsh_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v, q = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.vector_search_many(v, q, 5).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in retrieval.vector_search_lsh(v, q, 5, 64).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_stale_documents(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, "PARSING"), (2, 2, t0, "PARSING"), (2, 3, t0 + dt.timedelta(minutes=5), "INDEXED"), (3, 4, t0 + dt.timedelta(hours=2), "INDEXED"), (3, 5, t0 + dt.timedelta(hours=4), "INDEXED")]
    stream = events.stale_documents_stream(events.replay(spark.createDataFrame(rows, "document_id long, seq long, ts timestamp, status string").orderBy("ts"), 1))
    path, state = events.scratch(spark, "stale"), events.scratch(spark, "state")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", path).trigger(availableNow=True).start().awaitTermination()
    assert [r["document_id"] for r in spark.read.schema("document_id long, last_ts timestamp, status string").parquet(path).collect()] == [1]


def test_replace_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    frame = lambda rows: spark.createDataFrame(rows, "document_id long, content string")
    events.replace_documents(spark, frame([(1, "a"), (1, "b"), (2, "c")]), path, 1)
    for _ in range(2):
        events.replace_documents(spark, frame([(1, "x"), (3, "y")]), path, 2)
    assert sorted((r["document_id"], r["content"]) for r in events.read_documents(spark, path).collect()) == [(1, "x"), (2, "c"), (3, "y")]


def test_lsh_recall_of_the_registered_query(spark):
    from corpusgraph.plans import retrieval_queries as queries

    d = "/root/testdata/sf0.01"
    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(retrieval.vector_search_many(queries.vectors(spark, d), queries.vector_queries(spark, d), 10))
    found = pairs(retrieval.vector_search_lsh(queries.vectors(spark, d), queries.vector_queries(spark, d), 10, 64))
    assert len(exact & found) / len(exact) >= 0.9


def test_embedding_of_whole_text(spark):
    df = spark.createDataFrame([(1, "a " * 20_000 + "tail"), (2, "a " * 20_000)], "k int, content string")
    got = {r["k"]: r["embedding"] for r in retrieval.hashed_embeddings(df, "k", "content").collect()}
    assert got[1] != got[2]
