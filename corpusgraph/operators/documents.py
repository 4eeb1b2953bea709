"""Documents, workspaces and their assets: filters, listings, counts, status.

Unless a function says otherwise: a null id is a group of its own where rows are grouped and meets nothing where they are joined, a
null text gives null (and is no text where texts are looked into), equal rows count each, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators.dedup import noise_reason, with_refs
from corpusgraph.operators.passages import Blocks

IN_PROGRESS = ("PROCESSING", "PARSING", "INDEXING")
ALLOWED = ("pdf", "txt", "md", "docx", "pptx")
MAX_BYTES = 50 * 1024 * 1024


def validate_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (filename, file_size) with file_type, accepted, reason."""
    kind = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    reason = F.when(~kind.isin(*ALLOWED), "unsupported type").when(F.col("file_size") > max_bytes, "too large")
    return files.withColumns({"file_type": kind, "reason": F.coalesce(reason, F.lit("")), "accepted": reason.isNull()})


def register_documents(files: DataFrame, workspace: Column) -> DataFrame:
    ok = validate_uploads(files).filter("accepted")
    return ok.select("filename", "file_type", "file_size", workspace.alias("workspace"), F.lit("PENDING").alias("status"))


_COMPARE = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}


def metadata_predicate(where: dict | None) -> Column:
    """A where-dictionary (equality, $eq $ne $gt $gte $lt $lte $in $nin, $and, $or) as a predicate, which Parquet scans can take."""
    out = F.lit(True)
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            part = F.lit(key == "$and")
            for w in value:
                part = part & metadata_predicate(w) if key == "$and" else part | metadata_predicate(w)
        elif isinstance(value, dict):
            part = F.lit(True)
            for op, v in value.items():
                part = part & _COMPARE[op](F.col(key), v)
        else:
            part = F.col(key) == value
        out = out & part
    return out


def metadata_filter(df: DataFrame, where: dict | None) -> DataFrame:
    return df.filter(metadata_predicate(where)) if where else df


def list_documents(docs: DataFrame, workspace: str) -> DataFrame:
    return docs.filter(F.col("workspace") == workspace).orderBy(F.col("updated_at").desc(), "id")


def filter_documents(docs: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """Filename holds the query, whatever its case; `parsing` stands for every status in progress."""
    df = docs.filter(F.contains(F.lower("filename"), F.lit(query.lower())))
    if status == "parsing":
        return df.filter(F.col("status").isin(*IN_PROGRESS))
    return df if status == "all" else df.filter(F.col("status") == status.upper())


def partition_batch(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """ids (id) with outcome: accepted, or why they are skipped."""
    known = docs.select("id", "status")
    outcome = F.when(F.col("status").isNull(), "missing").when(F.col("status").isin(*IN_PROGRESS), "in progress").otherwise("accepted")
    return ids.join(known, "id", "left").select("id", outcome.alias("outcome"))


def reindex_candidates(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("status").isin(*IN_PROGRESS))


def mark_stale(docs: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Documents in progress not updated for `minutes` become FAILED with a message."""
    stale = F.col("status").isin(*IN_PROGRESS) & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    message = F.concat(F.lit("Processing timed out after "), F.lit(str(minutes)), F.lit(" minutes"))
    return docs.withColumns({"error_message": F.when(stale, message), "status": F.when(stale, "FAILED").otherwise(F.col("status"))})


def reset_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents named in ids (id; repeats and null do not matter) as before processing: pending, counts 0, markdown and error null where docs has them."""
    mine = ids.select("id").distinct().withColumn("_mine", F.lit(True))
    met, reset = docs.join(mine, "id", "left"), F.coalesce("_mine", F.lit(False))
    fresh = {"status": F.lit("PENDING"), "chunk_count": F.lit(0), "image_count": F.lit(0), "markdown": F.lit(None), "error_message": F.lit(None)}
    return met.withColumns({c: F.when(reset, v).otherwise(F.col(c)) for c, v in fresh.items() if c in docs.columns}).select(docs.columns)


def validate_queries(df: DataFrame) -> DataFrame:
    """(question, top_k, message if there is one) with reason: why a request is refused, empty if it is not. Null is not refused."""
    n = F.length("question")
    reason = F.when((n < 1) | (n > 1000), "question length").when((F.col("top_k") < 1) | (F.col("top_k") > 20), "top_k")
    if "message" in df.columns:
        reason = reason.when((F.length("message") < 1) | (F.length("message") > 5000), "message length")
    return df.withColumn("reason", reason.otherwise(""))


def effective_k(top_k: Column, cap: int = 8, prefetch: int = 20) -> tuple[Column, Column]:
    k = F.least(top_k, F.lit(cap))
    return k, F.greatest(F.lit(prefetch), 3 * k)


def delete_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def clear_workspace(tables: dict[str, DataFrame], workspace: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (with a column workspace) without a workspace's rows, and how many went from each."""
    mine = F.col("workspace") == workspace
    counts = None
    for name, df in tables.items():
        row = df.filter(mine).agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = row if counts is None else counts.unionByName(row)
    return {name: df.filter(~mine | F.col("workspace").isNull()) for name, df in tables.items()}, counts


def vector_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """A metadata map for each chunk; the document's custom metadata wins over the standard keys.

    Chunks may have page_no, heading_path, image_refs and table_refs; what they lack or have as null is 0 or empty. Chunks of no
    document are left out.
    """
    d = docs.select(F.col("id").alias("document_id"), "workspace", "filename", "file_type", F.coalesce("custom_metadata", F.create_map().cast("map<string,string>")).alias("custom"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none) if c in chunks.columns else none
    page = F.coalesce(F.col("page_no"), F.lit(0)) if "page_no" in chunks.columns else F.lit(0)
    values = {
        "document_id": F.col("document_id").cast("string"), "chunk_index": F.col("chunk_index").cast("string"), "source": F.col("filename"), "file_type": F.col("file_type"),
        "page_no": page.cast("string"), "heading_path": F.array_join(listed("heading_path"), " > "), "has_table": T.has_table("content").cast("string"), "has_code": T.has_code("content").cast("string"),
        "image_ids": T.encode_list(listed("image_refs")), "table_ids": T.encode_list(listed("table_refs")), "image_urls": T.encode_list(F.transform(listed("image_refs"), lambda x: T.asset_url("workspace", x))),
    }
    own = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    rest = F.map_filter(own, lambda k, _: ~F.map_contains_key("custom", k))
    chunk_id = F.format_string("doc_%d_chunk_%d", "document_id", "chunk_index")
    return chunks.join(d, "document_id").withColumn("rest", rest).select(chunk_id.alias("chunk_id"), "document_id", "chunk_index", "content", F.map_concat("rest", "custom").alias("metadata"))


def vector_metadata_plain(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id and the metadata map of the older form, with char_start and char_end of the chunk; custom metadata wins, chunks of no document are left out."""
    d = docs.select(F.col("id").alias("document_id"), "filename", "file_type", F.coalesce("custom_metadata", F.create_map().cast("map<string,string>")).alias("custom"))
    values = {c: F.col(c).cast("string") for c in ("document_id", "chunk_index", "char_start", "char_end")}
    values |= {"source": F.coalesce("filename", F.lit("")), "file_type": F.coalesce("file_type", F.lit(""))}
    own = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, _: ~F.map_contains_key("custom", k))
    chunk_id = F.format_string("doc_%d_chunk_%d", "document_id", "chunk_index")
    return chunks.join(d, "document_id").select(chunk_id.alias("chunk_id"), F.map_concat(own, "custom").alias("metadata"))


def to_hits(rows: DataFrame) -> DataFrame:
    """Stored rows (chunk_id, content, metadata, score) as columns with defaults, lists decoded."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    listed = lambda k, separator="|": F.coalesce(T.decode_list(m(k), separator), F.array().cast("array<string>"))
    return rows.select(
        "chunk_id", "content", "score", F.coalesce(m("document_id").try_cast("bigint"), F.lit(0)).alias("document_id"), F.coalesce(m("chunk_index").try_cast("int"), F.lit(0)).alias("chunk_index"),
        F.coalesce(m("source"), F.lit("Unknown")).alias("source"), F.coalesce(m("page_no").try_cast("int"), F.lit(0)).alias("page_no"),
        listed("heading_path", " > ").alias("heading_path"), listed("image_ids").alias("image_refs"), listed("table_ids").alias("table_refs"),
        F.coalesce(m("has_table").try_cast("boolean"), F.lit(False)).alias("has_table"), F.coalesce(m("has_code").try_cast("boolean"), F.lit(False)).alias("has_code"),
    )


def resolve_settings(workspaces: DataFrame, size: int = 512, overlap: int = 50, language: str = "en") -> DataFrame:
    """A workspace's own settings, else the defaults; an overlap not below the size becomes a fifth of it."""
    s, o = F.coalesce("chunk_size", F.lit(size)), F.coalesce("chunk_overlap", F.lit(overlap))
    return workspaces.select("id", s.alias("chunk_size"), F.when(o >= s, F.floor(s / 5)).otherwise(o).cast("int").alias("chunk_overlap"), F.coalesce("kg_language", F.lit(language)).alias("kg_language"))


def document_chunks(ids: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each id: n_chunks of indexed documents, else a message."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    met = ids.join(docs.select("id", "status"), "id", "left").join(n, F.col("id") == F.col("document_id"), "left")
    indexed = F.coalesce(F.col("status") == "INDEXED", F.lit(False))
    return met.select("id", F.when(indexed, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_chunks"), F.when(F.col("status").isNull(), "not found").when(indexed, "").otherwise("not indexed").alias("message"))


def workspace_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("workspace").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "INDEXED").alias("indexed"))


def rag_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if(F.col("status") == "INDEXED").alias("indexed_documents"), F.sum("chunk_count").alias("total_chunks"),
        F.sum("image_count").alias("total_images"), F.count_if(F.col("parser") == "docling").alias("deep_documents"),
    )


def document_breakdown(docs: DataFrame) -> DataFrame:
    """Each document with its bar (percent of the largest chunk count) and size label, newest first (by created_at, else updated_at, where docs have one; then id)."""
    most = docs.agg(F.max("chunk_count").alias("most"))
    size = F.when(F.col("file_size") >= 1 << 20, F.format_string("%.1f MB", F.col("file_size") / (1 << 20))).otherwise(F.format_string("%d KB", F.round(F.col("file_size") / 1024).cast("int")))
    bar = 100.0 * F.coalesce("chunk_count", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("most", F.lit(1)))
    age = next(([F.desc(c)] for c in ("created_at", "updated_at") if c in docs.columns), [])
    ordered = docs.crossJoin(F.broadcast(most)).orderBy(*age, F.desc("id"))  # one row
    return ordered.select("id", "filename", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), bar.alias("bar"), size.alias("size_label"))


def status_counts(docs: DataFrame) -> DataFrame:
    """A row for each status and one for all."""
    counted = docs.rollup("status").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


def page_rows(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def image_counts(images: DataFrame, docs: DataFrame) -> DataFrame:
    return images.join(docs.select(F.col("id").alias("document_id"), "workspace"), "document_id").groupBy("workspace").agg(F.count(F.lit(1)).alias("n_images"))


def related_assets(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets on the pages (above 0) of retrieved chunks, each id once: the one of the smallest document and page. Null pages have none."""
    pages = chunks.filter("page_no > 0").select("document_id", "page_no").distinct()
    first = F.row_number().over(Window.partitionBy("asset_id").orderBy("document_id", "page_no"))
    return assets.join(pages, ["document_id", "page_no"], "left_semi").withColumn("_r", first).filter("_r = 1").drop("_r")


def resolve_assets(hits: DataFrame, assets: DataFrame, k: int = 3) -> DataFrame:
    """At most k assets for each query: those its chunks list; only if there is none, those on its chunks' pages."""
    listed = hits.select("query_id", "rank", F.explode("image_refs").alias("asset_id")).join(assets, "asset_id")
    listed = listed.groupBy("query_id", "asset_id").agg(F.min("rank").alias("rank"))
    paged = hits.filter("page_no > 0").join(listed.select("query_id").distinct(), "query_id", "left_anti")
    paged = paged.join(assets, ["document_id", "page_no"]).groupBy("query_id", "asset_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "asset_id"))
    return listed.unionByName(paged).withColumn("place", place).filter(F.col("place") <= k).select("query_id", "asset_id", "place")


def page_groups(images: DataFrame) -> DataFrame:
    return images.groupBy("document_id", "page_no").agg(F.sort_array(F.collect_list("asset_id")).alias("asset_ids"))


def attach_page_assets(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """The first chunk of each page gets the page's assets and their captions."""
    grouped = assets.groupBy("document_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("asset_id", "caption"))).alias("found"))
    first = F.row_number().over(Window.partitionBy("document_id", "page_no").orderBy("chunk_index")) == 1
    met = chunks.withColumn("first", first).join(grouped, ["document_id", "page_no"], "left")
    refs = F.when(F.col("first"), F.coalesce(F.transform("found", lambda x: x["asset_id"]), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    captions = F.when(F.col("first"), F.array_join(F.transform("found", lambda x: x["caption"]), "\n"))
    return met.select("document_id", "page_no", "chunk_index", F.concat_ws("\n\n", "content", F.nullif(captions, F.lit(""))).alias("content"), refs.alias("image_refs"))


def pool_embeddings(parts: DataFrame) -> DataFrame:
    """Mean of the vectors of a key, weighted by max(1, length); NaN counts as 0."""
    x = parts.select("key", F.greatest(F.lit(1), "length").alias("w"), F.posexplode("embedding").alias("i", "x"))
    x = x.withColumn("x", F.when(F.isnan("x") | F.col("x").isNull(), 0.0).otherwise(F.col("x").cast("double")))
    means = x.groupBy("key", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def profile_chunks(chunks: DataFrame) -> DataFrame:
    """One projection over chunks: normalized text, hash, meaningful length, flags, size estimate."""
    return chunks.select(
        "document_id", "chunk_index", T.normalize_text("content").alias("normalized"), T.content_hash("content").alias("hash"), T.meaningful_len("content").alias("meaningful"),
        T.is_boilerplate("content").alias("boilerplate"), T.has_table("content").alias("has_table"), T.has_code("content").alias("has_code"), T.estimate_chunks(F.length("content")).alias("n_chunks"),
    )


def profile_counts(chunks: DataFrame, min_len: int = 50) -> DataFrame:
    """workspace, reason, n: chunks (with workspace) by why the noise filter drops them; kept ones have the reason kept."""
    reason = F.coalesce(noise_reason(min_len), F.lit("kept"))
    return with_refs(chunks).groupBy("workspace", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def usable_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.length(T.strip("content")) > 20)


def preview(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.substring("content", 1, 500).alias("preview"))


def list_workspaces(docs: DataFrame, by: str = "updated") -> DataFrame:
    """workspace, updated_at: latest first, or by name."""
    w = docs.groupBy("workspace").agg(F.max("updated_at").alias("updated_at"))
    return w.orderBy(F.desc("updated_at"), "workspace") if by == "updated" else w.orderBy("workspace")


def link_assets(docs: DataFrame, assets: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Documents whose image placeholders show the document's assets in order, whose links to asset names (asset_id, or name where assets have one) lead to their URLs, and without page markers."""
    url, name = T.asset_url(workspace, "asset_id"), F.col("name" if "name" in assets.columns else "asset_id")
    placed = assets.join(docs.select(F.col("id").alias("document_id"), workspace), "document_id").withColumn("a", F.struct("page_no", "asset_id", "caption", url.alias("url"), name.alias("name")))
    grouped = placed.groupBy("document_id").agg(F.sort_array(F.collect_list("a")).alias("assets")).withColumnRenamed("document_id", "id")
    met = docs.join(grouped, "id", "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<struct<page_no:int,asset_id:string,caption:string,url:string,name:string>>")))
    return met.select("id", T.strip_page_markers(T.relink_images(T.inject_images("text", "assets"), "assets")).alias("text"))


def prepare_embedding_inputs(chunks: DataFrame, limit: int = 1600, overlap: int = 200) -> DataFrame:
    """document_id, chunk_index, part, input: clean inputs, over-long ones in parts (see pool_embeddings)."""
    from corpusgraph.operators.chunking import split_for_embedding

    return chunks.select("document_id", "chunk_index", F.posexplode(split_for_embedding(T.sanitize_embed_input("content"), limit, overlap)).alias("part", "input"))


def search_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """df with match_form, slug, needle and keywords (distinct, in order) of a text; a null text has no keywords, an empty needle, and null for the others."""
    return df.withColumns({"match_form": T.match_form(text), "slug": T.heading_slug(text), "needle": T.search_needle(text), "keywords": F.coalesce(T.question_keywords(text), F.array().cast("array<string>"))})


def locate_passage(needles: DataFrame, blocks: DataFrame) -> DataFrame:
    """needle_id, block_no, score: the block of its document that holds a needle (document_id, needle) whole, else the one with most of its words.

    Both are compared without accents, case and punctuation. Of the needle's first 12 distinct words of four characters at least,
    max(2, 40 %) must be in the block; the first block wins a tie. Needles without letters or digits, null ones too, are found nowhere.

    A document's needles are one row, and its blocks another, as its text was; they meet there, so nothing but these rows and what is
    found is shuffled. Of rows of one needle_id the best counts; null ids, numbers and texts meet nothing.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("needle_id", needles), ("block_no", blocks))}
    gathered = lambda df, c, text, name: df.select("document_id", c, T.match_form(text).alias("t")).filter(F.col("document_id").isNotNull() & F.col(c).isNotNull() & (F.col("t") != "")).groupBy("document_id").agg(F.collect_list(F.struct(c, "t")).alias(name))
    met = gathered(needles, "needle_id", "needle", "asked").join(gathered(blocks, "block_no", "content", "held"), "document_id").select("asked", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column("asked")[i].values, batch.column("held")[i].values
                needle = asked.field("t").to_pylist()
                hay = Blocks(zip(held.field("block_no").to_pylist(), held.field("t").to_pylist(), strict=True), needle)
                found = {n: hay.find(n) for n in set(needle)}
                at = [j for j, n in enumerate(needle) if found[n]]
                if at:
                    block, score = zip(*(found[needle[j]] for j in at), strict=True)
                    yield pa.RecordBatch.from_arrays([asked.field("needle_id").take(pa.array(at)), pa.array(block, held.field("block_no").type), pa.array(score, pa.int32())], ["needle_id", "block_no", "score"])

    found = met.mapInArrow(run, f"needle_id {kinds['needle_id']}, block_no {kinds['block_no']}, score int")
    best = found.groupBy("needle_id").agg(F.max(F.struct("score", (-F.col("block_no")).alias("first"))).alias("best"))
    return best.select("needle_id", (-F.col("best.first")).alias("block_no"), F.col("best.score").alias("score"))
