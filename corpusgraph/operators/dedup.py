"""Chunk dedup in three steps: noise, exact copies, near copies; then the chunks are numbered anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T

#: Pairs that a task gives at a time (a chunk's own ones more).
PAIR_ROWS = 1 << 14


def noise_reason(min_len: int = 50):
    """Why a chunk is noise (null if it is not). Chunks with image or table references are kept."""
    refs = (F.size("image_refs") > 0) | (F.size("table_refs") > 0)
    return F.when(~refs & (T.strip("content") == ""), "empty").when(~refs & (T.meaningful_len("content") < min_len), "short").when(~refs & T.is_boilerplate("content"), "boilerplate")


def with_refs(chunks: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return chunks.withColumns({c: none for c in ("image_refs", "table_refs") if c not in chunks.columns})


def filter_noise(chunks: DataFrame, min_len: int = 50) -> DataFrame:
    return with_refs(chunks).withColumn("drop_reason", noise_reason(min_len))


def exact_rank():
    """1 for the first of the chunks of a document that have one normalized text."""
    return F.row_number().over(Window.partitionBy("document_id", "hash").orderBy("chunk_index"))


def dedup_exact(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash", T.content_hash("content")).withColumn("r", exact_rank()).filter("r = 1").drop("r", "hash")


def near_pairs(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """document_id, a, b (chunk_index, a < b), similarity of chunks of one document whose shingle sets are similar enough.

    A document's chunks are one row, as its text was, and are compared where it lies (_pairs). Null contents are empty ones, which are
    alike; chunks without a document or an index are in no pair. Pairs of a group of near copies are all given, so they grow with its square.
    """
    rows = _by_document(chunks.filter("document_id is not null and chunk_index is not null"))
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("document_id", "chunk_index")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("x")[i].values
                index = x.field("chunk_index")
                for a, b, similarity in _pairs(x.field("text").to_pylist(), threshold):
                    ends = [index.take(pa.array(at, pa.int64())) for at in (a, b)]
                    pairs = pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array([i] * len(a))), *ends, pa.array(similarity, pa.float64())], ["document_id", "a", "b", "similarity"])
                    yield pairs.filter(pc.not_equal(*ends))  # repeated rows of one chunk are no pair

    return rows.mapInArrow(run, f"document_id {kinds['document_id']}, a {kinds['chunk_index']}, b {kinds['chunk_index']}, similarity double")


def near_losers(pairs: DataFrame) -> DataFrame:
    """document_id, chunk_index of chunks similar to an earlier one that is kept itself: chunks are judged in order."""
    before = pairs.groupBy("document_id", "b").agg(F.sort_array(F.collect_list("a")).alias("befores"))
    ordered = before.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("b", "befores"))).alias("steps"))
    gone = F.aggregate("steps", F.array().cast("array<int>"), lambda lost, s: F.when(F.size(F.array_except(s["befores"], lost)) > 0, F.array_append(lost, s["b"])).otherwise(lost))
    return ordered.select("document_id", F.explode(gone).alias("chunk_index"))


def _shingles(text: str, n: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams of characters; a shorter text is its own only one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < n:
        return np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _rare(sets: list[np.ndarray], threshold: float) -> Iterator[list[int]]:
    """Of each set, numbers of its n - ceil(t n) + 1 rarest shingles, as far as other sets have them: two sets of similarity t share one of these."""
    sizes = np.array([len(own) for own in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(len(sets)), sizes), count[place]
    order = np.lexsort((place, often, owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[(rank < np.repeat(sizes - np.ceil(threshold * sizes).astype(np.int64) + 1, sizes)) & (often[order] > 1)]
    ends, numbers = np.cumsum(np.bincount(owner[order], minlength=len(sets))).tolist(), place[order].tolist()
    for start, end in zip([0, *ends], ends, strict=False):
        yield numbers[start:end]


def _similarity(own: np.ndarray, other: np.ndarray, threshold: float) -> float | None:
    """Of two sets, if it is the threshold at least."""
    if min(len(own), len(other)) < threshold * max(len(own), len(other)):
        return None
    both = len(np.intersect1d(own, other, assume_unique=True))
    similarity = both / (len(own) + len(other) - both)
    return similarity if similarity >= threshold else None


def _losers(texts: list[str], threshold: float) -> list[int]:
    """Which of the texts, in order, are similar to an earlier one that is not itself one of these.

    A text meets only the kept ones that share a rare shingle; a group of near copies has one kept text, so it is never compared pair
    by pair.
    """
    sets = [_shingles(t) for t in texts]
    lost, kept = [], {}
    for i, rare in enumerate(_rare(sets, threshold)):
        if any(_similarity(sets[i], sets[j], threshold) is not None for j in {j for x in rare for j in kept.get(x, ())}):
            lost.append(i)
        else:
            for x in rare:
                kept.setdefault(x, []).append(i)
    return lost


def _pairs(texts: list[str], threshold: float) -> Iterator[tuple[list[int], list[int], list[float]]]:
    """All pairs of texts that are similar enough, as places of the earlier ones, of the later ones, and similarities, some PAIR_ROWS at a time."""
    sets = [_shingles(t) for t in texts]
    met, first, second, how = {}, [], [], []
    for i, rare in enumerate(_rare(sets, threshold)):
        for j in {j for x in rare for j in met.get(x, ())}:
            similarity = _similarity(sets[i], sets[j], threshold)
            if similarity is not None:
                first.append(j)
                second.append(i)
                how.append(similarity)
        for x in rare:
            met.setdefault(x, []).append(i)
        if len(first) >= PAIR_ROWS:
            yield first, second, how
            first, second, how = [], [], []
    if first:
        yield first, second, how


def _by_document(chunks: DataFrame) -> DataFrame:
    """document_id, x: the chunks (chunk_index, normalized text) of each document of several, in order; null contents are empty ones."""
    each = F.struct("chunk_index", T.normalize_text(F.coalesce("content", F.lit(""))).alias("text"))
    return chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(each)).alias("x")).filter(F.size("x") > 1)


def near_losers_in_order(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """document_id, chunk_index of the chunks that near_losers(near_pairs(chunks, threshold)) gives, judged where a document's chunks lie.

    A document's chunks are one row, as its text was, so nothing but that row is shuffled. Null contents are empty ones, which are alike.
    """
    rows = _by_document(chunks)
    kinds = [(c, chunks.schema[c].dataType.simpleString()) for c in ("document_id", "chunk_index")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i in range(batch.num_rows):
                x = batch.column("x")[i].values
                lost = _losers(x.field("text").to_pylist(), threshold)
                owner += [i] * len(lost)
                found.append(x.field("chunk_index").take(pa.array(lost, pa.int64())))
            if owner:
                yield pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array(owner)), pa.concat_arrays(found)], ["document_id", "chunk_index"])

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds))


def dedup_near(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    if threshold >= 1:
        return chunks
    return chunks.join(near_losers_in_order(chunks, threshold), ["document_id", "chunk_index"], "left_anti")


def renumber(chunks: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    return chunks.withColumn("old_index", F.col("chunk_index")).withColumn("chunk_index", place)


def judged(chunks: DataFrame, min_len: int = 50, threshold: float = 0.85) -> DataFrame:
    """Every chunk with drop_reason: noise, exact, near, or null for those kept."""
    noted = filter_noise(chunks, min_len)
    quiet = noted.filter(F.col("drop_reason").isNull()).withColumn("hash", T.content_hash("content")).withColumn("r", exact_rank())
    near = near_losers_in_order(quiet.filter("r = 1"), threshold).withColumn("near", F.lit(True))
    kept = quiet.join(near, ["document_id", "chunk_index"], "left").withColumn("drop_reason", F.when(F.col("r") > 1, "exact").when(F.col("near"), "near"))
    noise = noted.filter(F.col("drop_reason").isNotNull()).withColumn("drop_reason", F.lit("noise"))
    cols = [*with_refs(chunks).columns, "drop_reason"]
    return kept.select(cols).unionByName(noise.select(cols))


def deduplicate(chunks: DataFrame, min_len: int = 50, threshold: float = 0.85, enabled: bool = True) -> DataFrame:
    return renumber(judged(chunks, min_len, threshold).filter(F.col("drop_reason").isNull()).drop("drop_reason")) if enabled else chunks


def dedup_stats(chunks: DataFrame, min_len: int = 50, threshold: float = 0.85) -> DataFrame:
    why = F.col("drop_reason")
    return judged(chunks, min_len, threshold).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(why == "noise").alias("noise_removed"), F.count_if(why == "exact").alias("exact_removed"),
        F.count_if(why == "near").alias("near_removed"), F.count_if(why.isNull()).alias("n_output"),
    )
