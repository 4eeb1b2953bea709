import pytest

import corpus_pipeline
from corpusgraph.llm import common, decontam

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What each stage leaves, the given documents first."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_filters_keep_clean_documents(steps, spark, sf_dir):
    docs, named, single, clean, mixed, written = steps
    assert named.count() == docs.filter(docs.text.rlike(r"\p{L}")).count()
    assert single.exceptAll(named).count() == 0
    texts = [r["text"] for r in single.collect()]
    assert len(texts) == len(set(texts))  # exact copies are gone
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontam.leaks(single, items).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaking


def test_mix_and_output(steps):
    clean, mixed, written = steps[-3:]
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= {r["doc_id"] for r in clean.collect()} and max(copies.values()) <= 2
    assert written.count() == mixed.count()
    words = lambda df: df.selectExpr("sum(regexp_count(text, '[^ \\t-\\r]+'))").first()[0]
    assert 1.0 <= words(mixed) / words(clean) <= 1.51


def test_run(spark, sf_dir, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, steps[-1].collect()))


@pytest.mark.parametrize("k", range(5), ids=NAMES)
def test_odd_rows_and_extra_columns(spark, sf_dir, k):
    rows = [(1, "the of and in", "en", "s", 13, 1.0), (1, "the of and in", "en", "s", 13, 1.0), (None, None, None, None, None, None), (2, "", "de", "s", 0, 1.0), (3, "the " * 40_000, "en", None, 160_000, 2.0), (4, "der die und", "de", "t", 11, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    got = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert got.columns == docs.columns or k == 4
    n = got.count()
    assert n == 6 if k in (2, 4) else n <= 10
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf_dir).count() == 0




def test_batches_are_bounded_by_bytes(spark, sf_dir):
    """After a stage a Python step gets a few megabytes at a time, not a whole split; a limit that the session has stays."""
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(1, "the of and in", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    own = spark.conf.get(key, None)
    try:
        for k in (0, 1, 2, 4):
            spark.conf.unset(key)
            corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
            got = [r["n"] for r in spark.range(0, 400, 1, 1).selectExpr("repeat(string(id % 10), 50000) text").mapInArrow(sizes, "n long").collect()]
            assert len(got) > 1 and max(got) < common.BATCH_BYTES + 100_000
        spark.conf.set(key, "1234567")
        corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
