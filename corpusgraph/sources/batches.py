"""Tables to which batches are added: the rows of a batch take the place of what earlier ones hold of the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table: rows, and the keys that a batch speaks for, both with a folder for each batch.
ROWS, KEYS = "rows", "keys"


def _folder(path: str, part: str, batch: int) -> str:
    return f"{path.rstrip('/')}/{part}/batch={batch}"


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    base = f"{path.rstrip('/')}/{part}"
    try:
        return spark.read.option("basePath", base).option("mergeSchema", "true").parquet(base).withColumn("batch", F.col("batch").cast("long"))
    except Exception as e:  # no batch yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def put_batch(rows: DataFrame, path: str, key: list[str], batch: int, keys: DataFrame | None = None) -> None:
    """Add a batch: its keys (those of rows, and more in `keys` that end without rows) have these rows from now on.

    Only the batch's own two folders are written, so the work grows with the batch, not with the table; a batch that runs again
    overwrites them and changes nothing else, and writers with different batch numbers do not meet. The later number wins. Readers see
    a batch once its keys are there, which is last. keys may have more columns, which key_rows shows.
    """
    rows.write.mode("overwrite").parquet(_folder(path, ROWS, batch))
    named = rows.sparkSession.read.schema(rows.schema).parquet(_folder(path, ROWS, batch)).select(*key).distinct() if keys is None else keys
    named.write.mode("overwrite").parquet(_folder(path, KEYS, batch))


def key_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The latest row of each key, with batch; None if there is no batch."""
    keys = read_part(spark, path, KEYS)
    if keys is None:
        return None
    rest = [c for c in keys.columns if c not in key]
    return keys.groupBy(*key).agg(F.max(F.struct("batch", *[c for c in rest if c != "batch"])).alias("x")).select(*key, "x.*")


def read_batches(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The rows of each key's latest batch, with batch; None if there is no batch. Null keys equal each other."""
    rows, last = read_part(spark, path, ROWS), key_rows(spark, path, key)
    if rows is None or last is None:
        return None
    last = last.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("batch").alias("_batch"))
    met = F.col("batch") == F.col("_batch")
    for c in key:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(last, met, "left_semi")


def compact(spark: SparkSession, path: str, to: str, key: list[str]) -> None:
    """Write what a table holds now as a table of one batch, which readers then take instead."""
    rows, last = read_batches(spark, path, key), key_rows(spark, path, key)
    if rows is not None:
        batch = last.agg(F.max("batch")).first()[0]
        put_batch(rows.drop("batch"), to, key, batch, last.drop("batch"))
