"""Reading documents and evaluation rows, writing results and vector collections."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.batches import KEYS, read_part, put_batch, read_batches

EVAL_SCHEMA = "id string, category string, user_input string, reference string, reference_contexts array<string>, synthesizer_name string, response string, source_count int, latency_ms double, metrics map<string,double>"


#: A table of less bytes than this for each core is dealt to all cores after the scan.
DEAL_BYTES = 16 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one may be a single row group, which only one task can read: it is dealt to all cores, a larger one never is."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # the planner's estimate, from the file listing
    return df.repartition(cores) if 1 << 20 < size < DEAL_BYTES * cores else df


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, file_type, file_size, page_count, text of .txt and .md files; .txt that is not UTF-8 is read as Latin-1, .md then as UTF-8 with replacement."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).when(kind == "txt", F.decode("content", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return df.filter(kind.isin("txt", "md")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), kind.alias("file_type"), F.col("length").alias("file_size"), F.lit(1).alias("page_count"), text.alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_eval_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", "true").json(path)


COLLECTION = ["workspace", "chunk_id"]


def _collection_dims(spark: SparkSession, path: str) -> DataFrame | None:
    """workspace, dim, since: the dimension of each workspace's latest batch, and the last batch before it of another one (none: null)."""
    keys = read_part(spark, path, KEYS)
    if keys is None:
        return None
    each = keys.groupBy("workspace", "batch").agg(F.max("dim").alias("dim"))  # a row for each batch of a workspace
    last = each.groupBy("workspace").agg(F.max_by("dim", "batch").alias("now"))
    met = each.join(last, "workspace")
    return met.groupBy("workspace").agg(F.first("now").alias("dim"), F.max(F.when(~F.col("dim").eqNullSafe(F.col("now")), F.col("batch"))).alias("since"))


def write_vectors(df: DataFrame, path: str, on_dim_change: str = "replace", batch: int | None = None) -> None:
    """Upsert vectors (workspace, chunk_id, embedding, ...) into a collection.

    Only the batch is written. Rows of a workspace stay beside it if its dimension is theirs; if the dimension changed the batch takes
    the place of all of them (or, with on_dim_change="error", an error is raised). batch numbers the write (the time unless given); the
    same one written again takes its own place.
    """
    spark = df.sparkSession
    keys = df.select(*COLLECTION, F.size("embedding").alias("dim"))
    old = _collection_dims(spark, path) if on_dim_change == "error" else None
    if old is not None:
        now = keys.groupBy("workspace").agg(F.max("dim").alias("now"))
        if old.join(now, "workspace").filter("dim <> now").head(1):
            raise ValueError("the dimension of a collection changed")
    put_batch(df, path, COLLECTION, time.time_ns() if batch is None else batch, keys.groupBy(*COLLECTION).agg(F.max("dim").alias("dim")))


def read_vectors(spark: SparkSession, path: str, workspace: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The vectors of a collection, or of a workspace, or those of ids (chunk_id)."""
    df, dims = read_batches(spark, path, COLLECTION), _collection_dims(spark, path)
    if df is None:
        raise FileNotFoundError(f"no collection at {path}")
    dims = dims.select(F.col("workspace").alias("_workspace"), "since")
    df = df.join(dims, F.col("workspace").eqNullSafe(F.col("_workspace"))).filter("since is null or batch > since").drop("_workspace", "since", "batch")
    df = df if workspace is None else df.filter(F.col("workspace") == workspace)
    return df if ids is None else df.join(ids.select("chunk_id"), "chunk_id", "left_semi")
