"""Frames of the data model derived from the given tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.files import read_table

STATUSES = ("PENDING", "PARSING", "PROCESSING", "INDEXING", "INDEXED", "FAILED")
TYPES = ("pdf", "txt", "md", "exe")


def _pick(values: tuple, by):
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def rounded(c: Column, digits: int) -> Column:
    """A double as SQL rounds it: scaled, rounded half away from zero, scaled back. Spark rounds its shortest decimal form instead, so 0.145 would be 0.15, not 0.14."""
    return F.round(c * 10.0**digits) / 10.0**digits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the source is the workspace; status, type and times follow from doc_id."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = _pick(TYPES, i * 7 % 4)
    return d.select(
        i.alias("id"), F.col("source").alias("workspace"), F.concat(F.lit("Report_"), i.cast("string"), F.lit("."), kind).alias("filename"), kind.alias("file_type"),
        F.col("n_chars").alias("file_size"), _pick(STATUSES, i * 5 % 7 % 6).alias("status"), F.size(F.split("text", "\n")).cast("bigint").alias("chunk_count"),
        (i % 5).alias("image_count"), F.when(i % 3 == 0, "docling").otherwise("legacy").alias("parser"),
        (F.timestamp_seconds(F.lit(1704067200) + i % 1000 * 60)).alias("updated_at"), F.col("lang"), F.col("text"),
    )


DOCS = """docs AS (SELECT doc_id AS id, source AS workspace, 'Report_' || doc_id || '.' || ['pdf', 'txt', 'md', 'exe'][CAST(doc_id * 7 % 4 + 1 AS INT)] AS filename,
  ['pdf', 'txt', 'md', 'exe'][CAST(doc_id * 7 % 4 + 1 AS INT)] AS file_type, n_chars AS file_size,
  ['PENDING', 'PARSING', 'PROCESSING', 'INDEXING', 'INDEXED', 'FAILED'][CAST(doc_id * 5 % 7 % 6 + 1 AS INT)] AS status,
  CAST(len(string_split(text, chr(10))) AS BIGINT) AS chunk_count, doc_id % 5 AS image_count, CASE WHEN doc_id % 3 = 0 THEN 'docling' ELSE 'legacy' END AS parser,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 1000 AS BIGINT)) AS updated_at, lang, text FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks; three lines are a page."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).withColumn("page_no", F.floor(F.col("chunk_index") / 3).cast("int"))


CHUNKS = """lines AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents),
chunks AS (SELECT document_id, CAST(i - 1 AS INT) AS chunk_index, l[i] AS content, CAST((i - 1) // 3 AS INT) AS page_no FROM (SELECT document_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines))"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images: as many for a document as its image_count says, one on each page from the first."""
    d = docs(spark, sf_dir).filter("image_count > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("image_count").cast("int") - 1)).alias("n"))
    return d.select(F.col("id").alias("document_id"), F.col("n").alias("page_no"), F.format_string("img-%d-%d", "id", "n").alias("asset_id"), F.format_string("Figure %d", "n").alias("caption"))


ASSETS = """assets AS (SELECT id AS document_id, CAST(n AS INT) AS page_no, 'img-' || id || '-' || n AS asset_id, 'Figure ' || n AS caption
  FROM (SELECT doc_id AS id, unnest(range(0, doc_id % 5)) AS n FROM documents))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of customers, suppliers, nations and regions."""
    t = lambda n: table(spark, sf_dir, n)
    part = lambda df, name, kind, note: df.select(F.col(name).alias("id"), F.lit(kind).alias("entity_type"), note.alias("description"))
    return (
        part(t("region"), "r_name", "Region", F.lit("")).unionByName(part(t("nation"), "n_name", "Nation", F.lit("A nation")))
        .unionByName(part(t("customer"), "c_name", "Customer", F.concat(F.lit("Buys "), F.col("c_mktsegment")))).unionByName(part(t("supplier"), "s_name", "Supplier", F.lit("Sells")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("lies in").alias("description"))
    name = t("nation").select("n_nationkey", "n_name")
    c = t("customer").join(name, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("lives in").alias("description"))
    s = t("supplier").join(name, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("sells from").alias("description"))
    return n.unionByName(c).unionByName(s).withColumns({"keywords": F.lit("place"), "weight": F.lit(1.0)})


GRAPH = """nodes AS (SELECT r_name AS id, 'Region' AS entity_type, '' AS description FROM region UNION ALL SELECT n_name, 'Nation', 'A nation' FROM nation
  UNION ALL SELECT c_name, 'Customer', 'Buys ' || c_mktsegment FROM customer UNION ALL SELECT s_name, 'Supplier', 'Sells' FROM supplier),
edges AS (SELECT n_name AS source, r_name AS target, 'lies in' AS description FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, n_name, 'lives in' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, n_name, 'sells from' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
degrees AS (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chat messages; answers cite by their turn."""
    m = table(spark, sf_dir, "conversations")
    cited = F.when(F.col("turn") % 4 == 1, " [1] and [2, 3].").when(F.col("turn") % 4 == 3, " [a3x9, IMG-p4f2]").otherwise("")
    return m.select("conv_id", "turn", "role", F.concat("text", F.when(F.col("role") == "assistant", cited).otherwise("")).alias("content"))


MESSAGES = """messages AS (SELECT conv_id, turn, role, text || CASE WHEN role <> 'assistant' THEN '' WHEN turn % 4 = 1 THEN ' [1] and [2, 3].' WHEN turn % 4 = 3 THEN ' [a3x9, IMG-p4f2]' ELSE '' END AS content FROM conversations)"""
