"""Search for many questions at once: vectors, BM25, their merge, reranking and cited context."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators.vectors import hashed_embeddings, vector_search, vector_search_lsh, vector_search_many  # noqa: F401
from corpusgraph.sources.shared import write_table

#: Questions, and words of all questions, up to which they are broadcast; more are joined by shuffling.
BROADCAST_TERMS = 200_000
#: Scores that a task holds at a time.
STEP = 1 << 21


def rank_by(partition: str, *order) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))


# --- vectors -------------------------------------------------------------------------------------------------------------------


def check_dim(queries: DataFrame, dim: int) -> DataFrame:
    """Queries with dim_ok: whether their vectors have the collection's dimension."""
    return queries.withColumn("dim_ok", F.coalesce(F.size("embedding") == dim, F.lit(False)))


@dataclass(frozen=True)
class Loaded:
    """A model that each Python worker loads once, however many tasks it runs."""

    load: Callable[[], Callable]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def get(self) -> Callable:
        if self.key not in _MODELS:
            _MODELS[self.key] = self.load()
        return _MODELS[self.key]


_MODELS: dict[str, Callable] = {}


def _retried(model: Callable[[list], list], rows: list, tries: int, failed: Callable[[str], object]) -> list:
    """What the model gives for rows; a batch that fails `tries` times is halved until the bad row is alone, which gets failed(message)."""
    for _ in range(tries):
        try:
            return list(model(rows))
        except Exception as e:
            said = f"{type(e).__name__}: {e}"
    half = len(rows) // 2
    return [failed(said)] if len(rows) == 1 else _retried(model, rows[:half], tries, failed) + _retried(model, rows[half:], tries, failed)


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]] | Loaded, dim: int, text: str = "content", batch: int = 32, tries: int = 2) -> DataFrame:
    """df with embedding (of length 1) and embed_error, from a pluggable model of texts, in batches.

    A batch that fails `tries` times is halved until the bad row is alone, which gets a zero vector of dim and the message. NaN
    components are 0, zero vectors stay; a null or blank text is the text [empty].
    """

    @F.pandas_udf("embedding array<double>, embed_error string")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = model.get() if isinstance(model, Loaded) else model
        for s in parts:
            out = []
            for i in range(0, len(s), batch):
                for v in _retried(run, s.iloc[i : i + batch].tolist(), tries, lambda said: said):
                    x = np.zeros(dim) if isinstance(v, str) else np.nan_to_num(np.array(v, float))
                    out.append((x / (np.linalg.norm(x) or 1.0), v if isinstance(v, str) else None))
            yield pd.DataFrame(out, columns=["embedding", "embed_error"])

    return df.withColumn("_v", vectors(T.sanitize_embed_input(text))).select(*df.columns, "_v.embedding", "_v.embed_error")


def model_score(model: Callable[[list[tuple[str, str]]], list[float]] | Loaded, question: str = "question", content: str = "content", batch: int = 32, tries: int = 2) -> Column:
    """A scorer for rerank: scores of (question, content) pairs from a pluggable model, in batches.

    A pair on which the model fails, even alone, scores null, and so does one with a NaN score: null never passes a least score. Null
    texts are empty ones.
    """

    @F.pandas_udf("double")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = model.get() if isinstance(model, Loaded) else model
        for q, c in parts:
            pairs = list(zip(q.fillna("").tolist(), c.fillna("").tolist(), strict=True))
            yield pd.Series([x for i in range(0, len(pairs), batch) for x in _retried(run, pairs[i : i + batch], tries, lambda _: None)], dtype=float)

    return F.nanvl(scores(question, content), F.lit(None).cast("double"))


# --- words ---------------------------------------------------------------------------------------------------------------------

Tokenizer = Callable[[Column], Column]


def term_counts(chunks: DataFrame, tokens: Tokenizer = T.word_tokens) -> DataFrame:
    """term, df, words: chunks that have a term; the row of the null term counts all chunks and their words. One pass over the texts."""
    words = F.coalesce(tokens(F.col("content")), F.array().cast("array<string>"))
    each = chunks.select(words.alias("w")).select(F.size("w").alias("dl"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words"))


def lexical_stats(counts: DataFrame) -> DataFrame:
    """One row: n (chunks), avgdl; none for no chunks."""
    return counts.filter("term is null").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))


def bm25_idf(counts: DataFrame) -> DataFrame:
    """term, df, idf; a negative idf becomes a quarter of the mean over all terms."""
    total = counts.filter("term is null").select(F.col("df").alias("n"))
    raw = counts.filter("term is not null").crossJoin(F.broadcast(total)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row, as total
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_weights(queries: DataFrame, counts: DataFrame, tokens: Tokenizer = T.word_tokens) -> DataFrame:
    """query_id, term, weight: the idf of each word of a question, as often as the question has it."""
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return write_table(asked.join(bm25_idf(counts), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "bm25-weights")


def _mean_words(counts: DataFrame) -> float:
    stats = lexical_stats(counts).first()
    return float(stats["avgdl"] or 1) if stats else 1.0


def bm25_scores(chunks: DataFrame, queries: DataFrame, counts: DataFrame, k1: float = 1.5, b: float = 0.75, tokens: Tokenizer = T.word_tokens, weights: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score for chunks that share a word with the query; a word counts as often as the query has it.

    counts are the chunks' term_counts. Words that no question has are dropped before anything is grouped.
    """
    avgdl = _mean_words(counts)
    weights = term_weights(queries, counts, tokens) if weights is None else weights
    few = F.broadcast if weights.count() <= BROADCAST_TERMS else lambda df: df
    each = chunks.select("chunk_id", tokens(F.col("content")).alias("w")).select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    posted = each.join(few(weights.select("term").distinct()), "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return posted.join(few(weights), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


class _Best:
    """The k best rows of each question among the blocks of chunks seen so far, by score to 9 places, then chunk id."""

    def __init__(self, n: int, k: int, ids: np.dtype):
        self.k, self.score, self.exact, self.ids = k, np.full((n, k), -np.inf), np.zeros((n, k)), np.zeros((n, k), ids)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def see(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each chunk, a column for each of the queries."""
        rounded = np.round(scores, 9)
        if ids.dtype.kind == "U" and ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        for j in np.flatnonzero((rounded >= self.least()[queries]).any(axis=0)).tolist():
            q, col = queries[j], rounded[:, j]
            near = np.flatnonzero(col >= self.score[q, -1])
            if len(near) > self.k:
                near = near[col[near] >= np.partition(col[near], len(near) - self.k)[len(near) - self.k]]
            s, e, x = (np.concatenate(y) for y in ((self.score[q], col[near]), (self.exact[q], scores[near, j]), (self.ids[q], ids[near])))
            best = np.lexsort((x, -s))[: self.k]
            self.score[q], self.exact[q], self.ids[q] = s[best], e[best], x[best]


def _scored_in_place(chunks: DataFrame, queries: DataFrame, weights: DataFrame, avgdl: float, k: int, k1: float, b: float, tokens: Tokenizer) -> DataFrame:
    """query_id, chunk_id, score: the k best chunks of each question in each task, from one pass over the chunks where they lie.

    A question's words and weights go to all tasks. A block of chunks is a sparse product: its counts of asked words by the weights. The
    largest value that a word reaches in a block bounds what a question can score there; blocks that cannot reach a question's k-th
    score so far are skipped for it.
    """
    names = [r[0] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]  # as many as bm25_search has checked
    number, vocab = {x: i for i, x in enumerate(names)}, {}
    rows = sorted((vocab.setdefault(r["term"], len(vocab)), number[r["query_id"]], r["weight"]) for r in weights.collect())
    term, query, weight = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    heads = np.searchsorted(term, np.arange(len(vocab) + 1))
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((vocab, term, query, weight, heads))
    whole = chunks.schema["chunk_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    n_queries = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, term, query, weight, heads = sent.value
        best, gain = _Best(n_queries, k, np.dtype(np.int64) if whole else np.dtype("U1")), np.maximum(weight, 0)
        step = max(1, STEP // max(1, n_queries))
        for batch in (b for whole_batch in batches for at in range(0, whole_batch.num_rows, step) for b in [whole_batch.slice(at, step)]):
            n, words = batch.num_rows, batch.column("w")
            ids = batch.column("chunk_id").to_numpy() if whole else np.array(batch.column("chunk_id").to_pylist(), str)
            dl = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            known = np.array([vocab.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            t = known[coded.indices.to_numpy(zero_copy_only=False)] if dl.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(n), dl)[t >= 0]
            pair, tf = np.unique(owner * max(1, len(vocab)) + t[t >= 0], return_counts=True)
            row, t = pair // max(1, len(vocab)), pair % max(1, len(vocab))
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            most = np.zeros(len(vocab))
            np.maximum.at(most, t, value)
            bound = np.bincount(query, gain * most[term], n_queries) if len(term) else np.zeros(n_queries)
            live = np.flatnonzero(bound >= best.least() - 1e-8)
            if not len(live):
                continue
            column = np.full(n_queries, -1)
            column[live] = np.arange(len(live))
            times = np.diff(heads)[t]
            at = np.repeat(heads[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
            to = column[query[at]] if len(at) else np.zeros(0, np.int64)
            on = to >= 0
            scores = np.bincount((np.repeat(row, times) * len(live) + to)[on], (np.repeat(value, times) * weight[at])[on] if len(at) else None, n * len(live))
            best.see(live, scores.reshape(n, len(live)).astype(float), ids)
        found = np.isfinite(best.score)
        q = np.repeat(np.arange(n_queries), k).reshape(-1, k)[found]
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best.ids[found]), pa.array(best.exact[found])], ["_q", "chunk_id", "score"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    words = chunks.filter("chunk_id is not null").select(F.col("chunk_id").cast("long" if whole else "string"), F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("w"))
    found = words.mapInArrow(run, f"_q int, chunk_id {'long' if whole else 'string'}, score double").withColumn("chunk_id", F.col("chunk_id").cast(kind))
    index = spark.createDataFrame(list(enumerate(names)), f"_q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return found.join(F.broadcast(index), "_q").select("query_id", "chunk_id", "score")


def _first_unscored(chunks: DataFrame, short: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score 0: the k smallest chunk ids without a score of each short question.

    Chunks are numbered by id. Up to the i-th scored chunk of a question, of number n, there are n - i without a score; so the j-th
    without one has the number j plus how many scored chunks have less than j before them.
    """
    from corpusgraph.operators.chat import numbered_rows

    numbers = numbered_rows(chunks.select("chunk_id").filter("chunk_id is not null"), "_n", "chunk_id")
    order = Window.partitionBy("query_id").orderBy("_n")
    before = scored.join(numbers, "chunk_id").withColumn("_gap", F.col("_n") - F.row_number().over(order)).filter(F.col("_gap") < k)
    each = before.groupBy("query_id").agg(*[F.count_if(F.col("_gap") < j).alias(f"_{j}") for j in range(1, k + 1)])
    met = short.select("query_id").distinct().join(each, "query_id", "left")
    wanted = met.select("query_id", F.explode(F.array(*[F.coalesce(F.col(f"_{j}"), F.lit(0)) + j for j in range(1, k + 1)])).alias("_n"))
    return wanted.join(numbers, "_n").select("query_id", "chunk_id", F.lit(0.0).alias("score"))


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, tokens: Tokenizer = T.word_tokens, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of each query, by the score rounded to 9 places, then chunk_id.

    With where, the chunks that do not meet it are not there: they count in no statistic. Chunks without a common word score 0, so
    they rank above negative scores (of words most chunks have). Null texts have no words; chunks without an id count in the
    statistics and are never found; empty tables give no rows. The words of all questions are broadcast to one pass over the chunks;
    of more than BROADCAST_TERMS they are joined.
    """
    chunks = chunks if where is None else chunks.filter(where)
    counts = write_table(term_counts(chunks, tokens), "bm25-terms")
    best = lambda df: df.withColumn("rank", rank_by("query_id", F.desc(F.round("score", 9)), "chunk_id")).filter(F.col("rank") <= k)
    weights = term_weights(queries, counts, tokens)
    if weights.count() <= BROADCAST_TERMS and queries.count() <= BROADCAST_TERMS:
        return best(_scored_in_place(chunks, queries, weights, _mean_words(counts), k, k1, b, tokens))
    scores = write_table(bm25_scores(chunks.filter("chunk_id is not null"), queries, counts, k1, b, tokens, weights), "bm25-scores")
    enough = scores.filter("score > 5e-10").groupBy("query_id").count().filter(F.col("count") >= k)
    short = write_table(queries.join(enough, "query_id", "left_anti").select("query_id").distinct(), "bm25-short")
    scored = scores.join(short, "query_id", "left_semi").select("query_id", "chunk_id")
    return best(scores.unionByName(_first_unscored(chunks, short, scored, k)))


# --- both ----------------------------------------------------------------------------------------------------------------------


def merge_hybrid(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, ordinal, channel: vector hits, then keyword hits, each chunk where it first comes."""
    v = vector_hits.select("query_id", "chunk_id", "rank", F.lit(0).alias("turn"))
    both = v.unionByName(keyword_hits.select("query_id", "chunk_id", "rank", F.lit(1).alias("turn")))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("turn", "rank")).alias("at"))
    place = rank_by("query_id", "at.turn", "at.rank")
    return first.select("query_id", "chunk_id", place.alias("ordinal"), F.when(F.col("at.turn") == 0, "vector").otherwise("keyword").alias("channel"))


def coverage_score(question: str = "question", content: str = "content") -> Column:
    """Default scorer: the share of the question's words that the chunk has."""
    asked = F.array_distinct(T.word_tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, T.word_tokens(content))).cast("double"), F.size(asked)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, k: int, min_score: float = 0.15, fallback: int = 3) -> DataFrame:
    """The k best candidates (query_id, ordinal, ...) by score of at least min_score; if none has it, the first min(k, fallback) as they came."""
    scored = candidates.withColumn("score", score)
    passed = F.max(F.col("score") >= min_score).over(Window.partitionBy("query_id"))
    ranked = scored.withColumn("passed", passed).withColumn("by_score", rank_by("query_id", F.desc("score"), "ordinal"))
    keep = F.when(F.col("passed"), (F.col("score") >= min_score) & (F.col("by_score") <= k)).otherwise(F.col("ordinal") <= min(k, fallback))
    kept = ranked.filter(keep)
    return kept.withColumn("rank", F.when(F.col("passed"), F.col("by_score")).otherwise(F.col("ordinal"))).drop("passed", "by_score")


# Headings and words of the context text.
CONTEXT_HEADS = {"graph": "## Knowledge Graph Insights", "hits": "## Retrieved Document Sections", "images": "## Available Document Images", "tables": "## Available Document Tables"}
NOTHING_FOUND = "No relevant documents found for this query."


def _section(df: DataFrame, head: str, order: list[str], line: Column, name: str) -> DataFrame:
    """query_id and the lines of a query in order under a heading, with an empty line at the end."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"])
    return df.groupBy("query_id").agg(F.concat(F.lit(CONTEXT_HEADS[head] + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias(name))


def assemble_context(hits: DataFrame, graph: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context: graph insights (query_id, insights), ranked hits, images and tables of a query, each under its heading.

    hits: query_id, rank, content, file, page_no, heading_path; images: query_id, document_id, page_no, asset_id, caption; tables have
    num_rows and num_cols besides. With queries every query has a row, and one without anything says so; empty insights count as none.
    """
    cited = F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("] "), T.format_citation("file", "page_no", "heading_path"), F.lit("\n"), F.col("content"))
    parts = [_section(hits, "hits", ["rank"], F.concat(cited, F.lit("\n")), "h").withColumn("h", F.expr("substring(h, 1, length(h) - 1)"))]
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit(': "'), "caption", F.lit('"'))).otherwise("")
    page = F.col("page_no").cast("string")
    if graph is not None:
        said = graph.filter("coalesce(insights, '') <> ''")
        parts.append(said.select("query_id", F.concat(F.lit(CONTEXT_HEADS["graph"] + "\n"), "insights", F.lit("\n")).alias("g")))
    order = ["document_id", "page_no", "asset_id"]
    if images is not None:
        parts.append(_section(images, "images", order, F.concat(F.lit("- Image p."), page, caption, F.lit(" (id: "), "asset_id", F.lit(")")), "i"))
    if tables is not None:
        size = F.concat(F.lit(" ("), F.col("num_rows").cast("string"), F.lit("x"), F.col("num_cols").cast("string"), F.lit(")"))
        parts.append(_section(tables, "tables", order, F.concat(F.lit("- Table p."), page, size, caption), "t"))
    met = queries.select("query_id").distinct() if queries is not None else parts.pop(0)
    for p in parts:
        met = met.join(p, "query_id", "left" if queries is not None else "full")
    text = F.concat_ws("\n", *[F.col(c) for c in ("g", "h", "i", "t") if c in met.columns])
    return met.select("query_id", F.coalesce(F.nullif(text, F.lit("")), F.lit(NOTHING_FOUND)).alias("context"))


def assemble_context_flat(hits: DataFrame) -> DataFrame:
    """query_id, context: the cited hits of a query between rules."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.format_citation("file", "page_no", "heading_path"), F.lit("\n"), F.col("content"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def assemble_context_chunks(hits: DataFrame) -> DataFrame:
    """query_id, context: the older form, each hit of a query under its file (Unknown where it has none) and its place."""
    # Fixed value: the heading of a hit.
    head = F.concat(F.lit("[Source: "), F.coalesce("file", F.lit("Unknown")), F.lit(", Chunk "), F.col("rank").cast("string"), F.lit("]\n"), F.col("content"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", head.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def page_assets(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """query_id and the assets (document_id, page_no, asset_id, ...) on the pages above 0 of its hits, each once."""
    pages = hits.filter("page_no > 0").select("query_id", "document_id", "page_no").distinct()
    return pages.join(assets, ["document_id", "page_no"]).dropDuplicates(["query_id", "asset_id"])


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 8, mode: str = "hybrid", prefetch: int = 20, min_score: float = 0.15, where: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Retrieval of many questions: query_id, rank, channel, score and the columns of chunks.

    chunks (chunk_id, content, ...), queries (query_id, question); where picks the chunks to search, by any of their columns. vectors
    (chunk_id, embedding) are the offline default's unless given. max(prefetch, 3 k) vector hits and as many keyword hits are merged
    and reranked; mode vector_only leaves the words out.
    """
    n = max(prefetch, 3 * k)
    chunks = chunks if where is None else chunks.filter(where)
    v = hashed_embeddings(chunks, "chunk_id", "content") if vectors is None else vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    hits = vector_search_many(v, hashed_embeddings(queries, "query_id", "question"), n)
    words = bm25_search(chunks, queries, n) if mode != "vector_only" else hits.limit(0)
    merged = write_table(merge_hybrid(hits, words.select("query_id", "chunk_id", "rank")), "candidates")  # 2 n rows a query at most
    full = merged.join(chunks, "chunk_id").join(queries.select("query_id", "question"), "query_id")
    return rerank(full, coverage_score(), k, min_score).select("query_id", "rank", "channel", "score", *chunks.columns)


def retrieve_vector(chunks: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """Vector search alone: query_id, rank, distance and the columns of chunks, nearest first, without reranking."""
    chunks = chunks if where is None else chunks.filter(where)
    hits = write_table(vector_search_many(hashed_embeddings(chunks, "chunk_id", "content"), hashed_embeddings(queries, "query_id", "question"), k), "vector-hits")
    return hits.join(chunks, "chunk_id").select("query_id", "rank", "distance", *chunks.columns)


def answer_contexts(chunks: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, images: DataFrame, tables: DataFrame, k: int = 8, mode: str = "hybrid", where: Column | None = None) -> DataFrame:
    """query_id, context: the whole way from a question to the text that answers are written from.

    Hits of retrieve (chunks have document_id, file, page_no, heading_path), insights of the graph (but in vector_only), images and
    tables on the pages of the hits.
    """
    from corpusgraph.operators.graph import graph_context

    hits = write_table(retrieve(chunks, queries, k, mode, where=where), "hits")  # k rows a query at most
    graph = graph_context(queries, nodes, edges) if mode != "vector_only" else None
    return assemble_context(hits, graph, page_assets(hits, images), page_assets(hits, tables), queries)
