from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.functions.udfs import NAMES, SIGNATURES, register_udfs
from corpusgraph.operators.chunking import split_recursive

ODD = [None, "", " \n", "It's [a1b2, c3d4] “quoted” \\ back", "# A\n\n|a|b|\n|---|---|\n```x```", "Ärger über Straße, Đà Nẵng", "Copyright 2020 all rights reserved", "<unused7>: x", "w " * 3000]


def test_sql_gives_what_the_functions_give(spark, sf_dir):
    register_udfs(spark)
    texts = spark.createDataFrame([(t,) for t in ODD], "value string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("value")))
    texts.createOrReplaceTempView("texts")
    for name in NAMES:
        same = spark.sql(f"SELECT value, cg_{name}(value) AS got FROM texts").withColumn("want", getattr(T, name)("value"))
        assert same.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0, name


def test_split_text(spark):
    text = "One two three. " * 40 + "\n\n" + "four " * 50
    spark.createDataFrame([(1, text), (2, None)], "id long, text string").createOrReplaceTempView("t")
    register_udfs(spark)
    got = spark.sql("SELECT id, p.* FROM t, LATERAL cg_split_text(text, 100, 10) AS p ORDER BY chunk_index").collect()
    assert [(r["id"], r["content"]) for r in got] == [(1, x) for x in split_recursive(text, 100, 10)]


def test_functions_of_several_values(spark):
    rows = [("a.md", 2, ["A", "B"], "Some text of a chunk, long enough.", 5, 9, "Person", 700, [1, 2], [2, 3], "7"), ("b", 0, [], "", 0, 0, "X", 0, [], [], "k"), (None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "file string, page int, path array<string>, content string, first int, stop int, kind string, n long, a array<long>, b array<long>, id string")
    df.withColumns({"thinking": F.col("kind"), "workspace": F.col("id"), "image": F.col("file"), "items": F.col("path"), "query": F.col("n"), "place": F.col("page")}).createOrReplaceTempView("several")
    register_udfs(spark)
    for name, parameters in SIGNATURES.items():
        given = [p.split()[0] for p in parameters.split(", ")]
        got = spark.table("several").withColumns({"got": F.expr(f"cg_{name}({', '.join(given)})"), "want": getattr(T, name)(*map(F.col, given))})
        assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0, name
