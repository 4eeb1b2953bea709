"""Splitting documents: recursive characters, Markdown sections, tables, outlines, HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters (longer only where nothing parts them), cut at the first separator that occurs, each starting with up to `overlap` characters of the piece before."""
    mark, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), (separators[-1], ()))
    parts = list(text) if mark == "" else [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    out: list[str] = []
    run: list[str] = []

    def join() -> None:
        if whole := "".join(run).strip():
            out.append(whole)

    total = 0
    for p in parts:
        if len(p) >= size and rest:
            join()
            run, total = [], 0
            out += split_recursive(p, size, overlap, rest)
            continue
        if run and total + len(p) > size:
            join()
            while run and (total > overlap or total + len(p) > size):
                total -= len(run.pop(0))
        run.append(p)
        total += len(p)
    join()
    return out


PIECES = "document_id long, chunk_index int, content string, char_start int, char_end int, total_chunks int"


def chunk_recursive(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """document_id, chunk_index, content, char_start, char_end, total_chunks. A piece is located from a cursor by its first 50 characters; blank and null documents give no rows."""
    names, kinds = zip(*(x.split() for x in PIECES.split(", ")), strict=True)
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in zip(names, kinds, strict=True)])

    def located(text: str) -> Iterator[tuple]:
        pieces, at = (split_recursive(text, size, overlap) if text and text.strip() else []), 0
        for i, p in enumerate(pieces):
            start = text.find(p[:50], at)
            start = at if start < 0 else start
            yield i, p, start, start + len(p), len(pieces)
            at = max(start + len(p) - overlap, at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("document_id"), batch.column("text"), strict=True):
                rows += [(doc_id.as_py(), *x) for x in located(text.as_py())]
                if len(rows) >= 2000:  # so that pieces are not held beside a whole batch of texts
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("document_id").cast("long").alias("document_id"), "text").mapInArrow(run, PIECES)


def _fold(parts: Column, limit: int, glue: str) -> Column:
    """Neighbouring parts joined by `glue` as long as they stay within limit."""

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = F.length(last) + F.length(p) + len(glue) <= limit
        return F.when(F.size(done) == 0, F.array(p)).when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(glue), p)))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def pack_paragraphs(c: Column, max_tokens: int = 512) -> Column:
    """Pieces of four characters a token at most: paragraphs joined by blank lines, the sentences of over-long ones by spaces.

    An over-long paragraph begins a piece of its own, and what follows it may join its last sentences. Only a sentence longer than
    the limit makes a longer piece. A text within the limit is its own piece as it is; a null text gives null.
    """
    limit = max_tokens * 4
    unit = lambda text, glue, opens: F.struct(text.alias("text"), F.lit(glue).alias("glue"), opens.alias("opens"))
    sentences = lambda p: F.transform(F.split(p, r"(?U)(?<=[.!?])\s+"), lambda x, i: unit(x, " ", i == 0))
    units = F.flatten(F.transform(F.split(c, r"(?U)\n\s*\n"), lambda p: F.when(F.length(p) > limit, sentences(p)).otherwise(F.array(unit(p, "\n\n", F.lit(False))))))

    def step(state: Column, u: Column) -> Column:
        done, open_ = state["done"], state["open"]
        closes = u["opens"] | (F.length(open_) + F.length(u["text"]) + F.length(u["glue"]) > limit)
        closed = F.when(closes & (open_ != ""), F.array_append(done, T.strip(open_))).otherwise(done)
        joined = F.when(closes | (open_ == ""), u["text"]).otherwise(F.concat(open_, u["glue"], u["text"]))
        return F.struct(closed.alias("done"), joined.alias("open"))

    def finish(state: Column) -> Column:
        last = T.strip(state["open"])
        whole = F.when(last != "", F.array_append(state["done"], last)).otherwise(state["done"])
        return F.when(F.size(whole) > 0, whole)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.when(F.length(c) <= limit, F.array(c)).when(c.isNotNull(), F.coalesce(F.aggregate(units, start, step, finish), F.array(c)))


def sentence_windows(c: Column, limit: int = 900) -> Column:
    return F.filter(_fold(F.split(c, r"(?<=[.!?])\s+"), limit, " "), lambda x: F.trim(x) != "")


def split_for_embedding(c: Column, limit: int = 1600, overlap: int = 200) -> Column:
    """Sentence windows; a longer sentence is cut into overlapping pieces."""
    step = limit - overlap
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - overlap - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(s, i + 1, F.lit(limit)))
    return F.flatten(F.transform(sentence_windows(c, limit), lambda s: F.when(F.length(s) > limit, pieces(s)).otherwise(F.array(s))))


def lines_of(docs: DataFrame, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    return docs.select(*key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# Fixed value: what stands between the pages of a document.
PAGE_SEPARATOR = "-" * 48


def with_page(lines: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """Lines (document_id, line_no, line) with page_no: one more than the separator lines above; a separator itself ends its page. A null line is none."""
    above = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rule = F.coalesce((T.strip("line") == separator).cast("int"), F.lit(0))
    return lines.withColumn("page_no", (F.lit(1) + F.coalesce(F.sum(rule).over(above), F.lit(0))).cast("int"))


def page_lines(lines: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """The lines of each page, with page_no, without the separators."""
    return with_page(lines, separator).filter(F.coalesce(T.strip("line") != separator, F.lit(True)))


def split_pages(docs: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """document_id, page_no (from 1), text of the pages that are not blank, without a page mark {n} at their beginning. Null texts have no pages."""
    pages = docs.select("document_id", F.posexplode(F.split("text", re.escape(separator))).alias("at", "text"))
    return pages.select("document_id", (F.col("at") + 1).alias("page_no"), T.strip("text").alias("text")).filter("text <> ''").withColumn("text", F.regexp_replace("text", r"\A\{\d+\}\s*", ""))


def split_sections(docs: DataFrame, key: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """key, section_no, heading_path, content: text (of each document, or page) between Markdown headings with the headings above it.

    A heading closes those of its level and deeper, so the path is, for each level, the last heading since one that is shallower.
    Blank sections and null texts have no rows.
    """
    key = list(key)
    w = Window.partitionBy(*key).orderBy("line_no")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1))
    df = lines_of(docs, key).withColumn("level", level).withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w))
    heads = df.filter("level > 0").select(*key, "section_no", "level", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)).alias("title"))
    run = Window.partitionBy(*key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        seen = F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(run)
        heads = heads.withColumn(f"h{k}", F.when((seen["level"] == k) & (F.col("level") >= k), seen["title"]))
    heads = heads.select(*key, "section_no", F.filter(F.array(*[f"h{k}" for k in range(1, 7)]), lambda x: x.isNotNull()).alias("heading_path"))
    body = df.filter("level = 0").groupBy(*key, "section_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    body = body.withColumn("content", T.strip("content")).filter("content <> ''")
    return body.join(heads, [*key, "section_no"], "left").withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>")))


def attach_assets(chunks: DataFrame, images: DataFrame | None, tables: DataFrame | None) -> DataFrame:
    """Chunks (document_id, page_no, chunk_index, content) with image_refs and table_refs: the first chunk of a page has the page's assets.

    assets have document_id, page_no, asset_id, caption, tables num_rows and num_cols besides; their captions follow the content, images
    first, by asset_id. An asset that stands on several pages belongs to the first that has chunks; pages of 0 or less have none, and
    blank captions say nothing.
    """
    pages = chunks.groupBy("document_id", "page_no").agg(F.min("chunk_index").alias("chunk_index")).filter("page_no > 0")
    out = chunks
    for assets, refs, what in ((images, "image_refs", "Image"), (tables, "table_refs", "Table")):
        if assets is None:
            out = out.withColumn(refs, F.array().cast("array<string>"))
            continue
        size = F.concat(F.lit(" ("), F.col("num_rows").cast("string"), F.lit("x"), F.col("num_cols").cast("string"), F.lit(")")) if what == "Table" else F.lit("")
        # Fixed value: how a caption stands in a chunk.
        line = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit(f"[{what} on page "), F.col("page_no").cast("string"), size, F.lit("]: "), "caption"))
        placed = assets.withColumn("_line", line).join(pages, ["document_id", "page_no"]).groupBy("document_id", "asset_id").agg(F.min(F.struct("chunk_index", "_line")).alias("x"))
        grouped = placed.groupBy("document_id", F.col("x.chunk_index").alias("chunk_index")).agg(F.sort_array(F.collect_list(F.struct("asset_id", F.col("x._line").alias("line")))).alias("_found"))
        told = F.array_join(F.filter(F.transform("_found", lambda a: a["line"]), lambda x: x.isNotNull()), "\n")
        out = out.join(grouped, ["document_id", "chunk_index"], "left").withColumn(refs, F.coalesce(F.transform("_found", lambda a: a["asset_id"]), F.array().cast("array<string>")))
        out = out.withColumn("content", F.concat_ws("\n\n", "content", F.nullif(told, F.lit("")))).drop("_found")
    return out


def chunk_markdown(docs: DataFrame, max_tokens: int = 512, images: DataFrame | None = None, tables: DataFrame | None = None, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """document_id, chunk_index, page_no, content, heading_path, has_table, has_code, contextualized, image_refs, table_refs of Markdown documents.

    Pages are split first, so headings hold for their page; assets and their captions go to the first chunk of a page (attach_assets).
    Blank and null documents give no chunks.
    """
    pages = split_sections(split_pages(docs, separator), ("document_id", "page_no"))
    pieces = pages.select("document_id", "page_no", "section_no", "heading_path", F.posexplode(pack_paragraphs(F.col("content"), max_tokens)).alias("piece", "content"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_no", "section_no", "piece")) - 1
    chunks = pieces.filter(F.trim("content") != "").select("document_id", index.alias("chunk_index"), "page_no", "content", "heading_path", T.has_table("content").alias("has_table"), T.has_code("content").alias("has_code"), T.contextualize("heading_path", "content").alias("contextualized"))
    return attach_assets(chunks, images, tables)


def extract_tables(docs: DataFrame, separator: str = PAGE_SEPARATOR) -> DataFrame:
    """document_id, table_no, page_no, content, num_rows, num_cols of runs of pipe lines; the rule below the header is no row."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    pipe = F.startswith(F.trim("line"), F.lit("|"))
    df = with_page(lines_of(docs), separator).withColumn("pipe", pipe).withColumn("island", F.col("line_no") - F.sum(F.col("pipe").cast("int")).over(w)).filter("pipe")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"]))
    t = df.groupBy("document_id", "island").agg(F.min("line_no").alias("first"), F.first("page_no").alias("page_no"), lines.alias("lines"))
    rule = lambda x: x.rlike(r"^\|[\s:|-]+\|?$")
    return t.filter(F.size("lines") >= 2).select(
        "document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("first")) - 1).alias("table_no"), "page_no", F.array_join("lines", "\n").alias("content"),
        (F.size(F.filter("lines", lambda x: ~rule(x))) - 1).alias("num_rows"), (F.size(F.split(F.trim(F.regexp_replace(F.element_at("lines", 1), r"^\||\|$", "")), r"\|"))).alias("num_cols"),
    )


def outline(docs: DataFrame) -> DataFrame:
    """document_id, line_no, level, title, slug of headings of levels 1 to 4."""
    level, title = F.length(F.regexp_extract("line", r"^(#{1,4})\s+(.+)$", 1)), F.trim(F.regexp_extract("line", r"^(#{1,4})\s+(.+)$", 2))
    return lines_of(docs).select("document_id", "line_no", level.alias("level"), title.alias("title"), T.heading_slug(title).alias("slug")).filter("level > 0")


def split_blocks(docs: DataFrame) -> DataFrame:
    """document_id, block_no, content: text between blank lines outside code fences and $$ formulas; a $$ within a fence is code."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    fence = F.startswith(F.trim("line"), F.lit("```"))
    coded = lines_of(docs).withColumn("coded", (F.sum(fence.cast("int")).over(w) % 2 == 1) | fence)
    math = ~F.col("coded") & (F.trim("line") == "$$")
    inside = (F.sum(math.cast("int")).over(w) % 2 == 1) | math
    df = coded.withColumn("inside", inside | F.col("coded")).withColumn("gap", ~F.col("inside") & (F.trim("line") == ""))
    df = df.withColumn("island", F.sum(F.col("gap").cast("int")).over(w)).filter("not gap")
    b = df.groupBy("document_id", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return b.select("document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("island")) - 1).alias("block_no"), "content")


def html_to_markdown(c: Column) -> Column:
    """Headings as #, list items as -, paragraphs as lines; scripts, styles and page furniture go, entities are decoded."""
    t = c
    for pattern, to in (
        (r"(?is)<(script|style|nav|footer|head)\b[^>]*>.*?</\1>", ""), (r"(?s)<!--.*?-->", ""), *((rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}>", "\n" + "#" * k + " $1\n") for k in range(1, 7)),
        (r"(?is)<li\b[^>]*>", "\n- "), (r"(?is)</?(p|div|br|ul|ol|tr|table|section|article)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", ""),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n\n"),
    ):
        t = F.regexp_replace(t, F.lit(pattern), F.lit(to))
    return T.strip(t)


def inject_table_captions(docs: DataFrame, captions: DataFrame) -> DataFrame:
    """document_id, text with a caption line after each table whose first three header cells match (document_id, key, caption)."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    df = lines_of(docs).withColumn("pipe", F.startswith(F.trim("line"), F.lit("|")))
    df = df.withColumns({"island": F.col("line_no") - F.sum(F.col("pipe").cast("int")).over(w), "ends": F.col("pipe") & ~F.coalesce(F.lead("pipe").over(w), F.lit(False))})
    cells = F.slice(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), 1, 3)
    heads = df.filter("pipe").groupBy("document_id", "island").agg(F.min_by(F.array_join(F.transform(cells, lambda x: F.trim(x)), "|"), "line_no").alias("key"))
    named = heads.join(captions, ["document_id", "key"]).select("document_id", "island", "caption")
    met = df.join(named, ["document_id", "island"], "left").withColumn("line", F.when(F.col("ends") & F.col("caption").isNotNull(), F.concat("line", F.lit("\n\n*"), "caption", F.lit("*"))).otherwise(F.col("line")))
    return met.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
