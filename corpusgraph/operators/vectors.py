"""Nearest vectors for many questions at once: exact search, inverted lists, embeddings of the offline model."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.sources.shared import write_table

#: Bytes of query vectors that are broadcast; more meet the vectors block by block.
BROADCAST_BYTES = 64 << 20
#: Vectors and queries of a block, and blocks of vectors that one task goes through, where queries are not broadcast.
BLOCK_ROWS, QUERY_ROWS, GROUP_BLOCKS = 8192, 16384, 64
#: Distances that a task holds at a time.
STEP = 1 << 22
#: Bounds of what inverted lists learn from: vectors of the sample, questions that measure recall, and lists.
SAMPLE_VECTORS, SAMPLE_QUERIES, MOST_LISTS = 20_000, 400, 1024
#: Share of the nearest of the sample's questions that the lists probed have to hold.
RECALL = 0.95


def vector_search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest of one query vector by cosine distance."""
    df = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.filter(F.size("embedding") == len(query)).select("chunk_id", T.cosine_distance("embedding", q).alias("distance")).orderBy("distance", "chunk_id").limit(k)


def usable(df: DataFrame, key: str) -> DataFrame:
    """key, unit (the normalized vector) of the rows with an id and a vector without null, NaN or infinite components."""
    x = F.col("embedding")
    good = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("key"), T.l2_normalize("embedding").alias("unit"))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class _Nearest:
    """The k nearest of each of some queries among the blocks of vectors seen so far, by distance to 9 places, then id."""

    def __init__(self, n: int, k: int):
        self.k, self.distance, self.ids = k, np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def see(self, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """rows: which of the queries these are."""
        step = max(1, STEP // max(1, len(ids)))
        for a in range(0, len(rows), step):
            distance = np.round(1 - queries[a : a + step] @ units.T, 9)
            part = rows[a : a + step]
            close = distance <= self.distance[part, -1][:, None]
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                near, q = np.flatnonzero(close[i]), part[i]
                if len(near) > self.k:
                    near = near[distance[i, near] <= np.partition(distance[i, near], self.k - 1)[self.k - 1]]
                d, x = np.concatenate([self.distance[q], distance[i, near]]), np.concatenate([self.ids[q], ids[near]])
                best = np.lexsort((x, d))[: self.k]
                self.distance[q], self.ids[q] = d[best], x[best]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        found = np.isfinite(self.distance)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, self.k).reshape(-1, self.k)[found]), pa.array(self.ids[found]), pa.array(self.distance[found])], ["query_id", "chunk_id", "distance"])


FOUND = "query_id long, chunk_id long, distance double"


def _by_broadcast(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates from one pass over the vectors (part, key, unit), to which all queries (parts, key, unit) are sent; a task gives k a query."""
    sent_rows = queries.select("key", "parts", "unit").toArrow().combine_chunks()  # as many as _nearest has checked
    names, parts, units = sent_rows["key"].to_numpy(), sent_rows["parts"].combine_chunks(), sent_rows["unit"].combine_chunks()
    owner, part = np.repeat(np.arange(len(names)), np.diff(parts.offsets.to_numpy())), parts.flatten().to_numpy(zero_copy_only=False)
    index = {}
    for p in np.unique(part).tolist():
        rows = owner[part == p]
        index[p] = (rows, _matrix(units.take(pa.array(rows)), len(rows)))
    sent = queries.sparkSession.sparkContext.broadcast((names, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = sent.value
        best = _Nearest(len(names), k)
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                if part in index:
                    mine = batch.take(pa.array(np.flatnonzero(parts == part)))
                    best.see(*index[part], mine.column("key").to_numpy(), _matrix(mine.column("unit"), mine.num_rows))
        yield best.rows(names)

    return vectors.mapInArrow(run, FOUND)


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates from a grid: blocks of vectors (part, key, unit) against blocks of queries (parts, key, unit) of the same part.

    A group of GROUP_BLOCKS blocks of vectors and a block of queries are one cell of the grid, which one task goes through and which
    gives k rows a query. The block of queries is copied to each group of its part, each block of vectors to each block of queries; as
    rows are dealt to blocks by number, no part, however large, and no id, however often it is given, makes a large cell.
    """
    asked = queries.select("key", "unit", F.explode("parts").alias("part"))
    count = lambda df: {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731 -- a row for each dimension or list
    nv, nq = count(vectors), count(asked)
    both = [p for p in nv if p in nq]
    number = lambda of: F.create_map(*[F.lit(x) for p in both for x in (p, of(p))])[F.col("part")] if both else F.lit(None).cast("int")
    v_blocks, v_groups, q_blocks = (number(f) for f in (lambda p: -(-nv[p] // BLOCK_ROWS), lambda p: -(-nv[p] // (BLOCK_ROWS * GROUP_BLOCKS)), lambda p: -(-nq[p] // QUERY_ROWS)))
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), n)
    packed = F.collect_list(F.struct("key", "unit"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v = vectors.filter(F.col("part").isin(both)).withColumn("_block", deal(v_blocks)).groupBy("part", "_block").agg(packed.alias("v_rows"))
    v = v.select("part", F.floor(F.col("_block") / GROUP_BLOCKS).cast("int").alias("v_group"), every(q_blocks).alias("q_block"), "v_rows")
    q = asked.filter(F.col("part").isin(both)).withColumn("q_block", deal(q_blocks).cast("int")).groupBy("part", "q_block").agg(packed.alias("q_rows"))
    q = q.select("part", every(v_groups).alias("v_group"), "q_block", "q_rows")
    cell = ["part", "v_group", "q_block"]
    pairs = v.join(q.hint("merge"), cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, names, units = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = tuple(batch.column(c)[i].as_py() for c in cell)
                if at != now:
                    if best is not None:
                        yield best.rows(names)
                    rows = batch.column("q_rows")[i].values
                    now, names, units = at, rows.field("key").to_numpy(), _matrix(rows.field("unit"), len(rows))
                    best = _Nearest(len(names), k)
                rows = batch.column("v_rows")[i].values
                best.see(np.arange(len(names)), units, rows.field("key").to_numpy(), _matrix(rows.field("unit"), len(rows)))
        if best is not None:
            yield best.rows(names)

    return pairs.mapInArrow(run, FOUND)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance, rank: the k nearest vectors (part, key, unit) among the parts of each query (parts, key, unit)."""
    queries = write_table(queries, "vector-queries")
    bytes_ = queries.agg(F.sum(8.0 * F.size("unit") * F.size("parts"))).first()[0] or 0
    found = _by_broadcast(vectors, queries, k) if bytes_ <= BROADCAST_BYTES else _by_blocks(vectors, queries, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: the k nearest vectors (of those that meet where) of each query (query_id, embedding), exactly.

    Queries of up to BROADCAST_BYTES are sent to all tasks, which go through the vectors where they lie; more meet them block by block.
    Either way a block is a matrix product, and only a task's k best of each query are shuffled. Ranks go by the distance rounded to 9
    places, then chunk_id. Zero vectors are at distance 1; vectors of another dimension than the query's, null ones, those with null,
    NaN or infinite components and those without an id take no part, nor do such queries; of a query_id given twice the best of both
    are ranked; empty tables give no rows.
    """
    v = usable(vectors if where is None else vectors.filter(where), "chunk_id").select(F.size("unit").alias("part"), "key", "unit")
    return _nearest(v, usable(queries, "query_id").select(F.array(F.size("unit")).alias("parts"), "key", "unit"), k)


# --- inverted lists ------------------------------------------------------------------------------------------------------------


@dataclass
class InvertedLists:
    """An index: vectors under the nearest of some centroids. A question is looked for in the `probes` lists nearest to it."""

    centroids: np.ndarray  # (lists, dim), of length 1; at most MOST_LISTS
    probes: int
    recall: float  # as measured on the sample, at this number of probes
    table: DataFrame | None = None  # part (the list), key, unit: every vector, ordered by list


def _learn(x: np.ndarray, lists: int, rng: np.random.Generator, passes: int = 12) -> np.ndarray:
    """Spherical k-means: centroids of length 1."""
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(passes):
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0]))
        c[own[order][heads]] = np.add.reduceat(x[order], heads, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> tuple[int, float]:
    """The fewest lists to probe so that they hold `recall` of the k nearest (among the sample, itself left out) of some of the sample."""
    asked = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    closeness = x[asked] @ x.T
    closeness[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1, 1.0
    near = np.argpartition(-closeness, k - 1, axis=1)[:, :k]
    own = (x @ c.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)  # of each list among a question's nearest
    held = np.bincount(np.take_along_axis(place, own[near], axis=1).ravel(), minlength=len(c)).cumsum() / near.size
    probes = int(np.searchsorted(held, min(recall, held[-1]))) + 1
    return probes, float(held[probes - 1])


def build_lists(vectors: DataFrame, dim: int, k: int = 10, lists: int | None = None, learn: bool = True, recall: float = RECALL, seed: int = 7) -> InvertedLists:
    """Index all vectors (chunk_id, embedding) of a dimension under centroids.

    Centroids (as many as the square root of the vectors, MOST_LISTS at most, unless given) are learned from the SAMPLE_VECTORS vectors
    with the smallest seeded hashes; without learn they are the axes of a random rotation, both ways (cross-polytope hashing). probes is the smallest number of lists that holds `recall` of the k nearest of SAMPLE_QUERIES of
    them: few where vectors gather in groups, most of the lists where they lie alike in all directions. Vectors that usable() leaves
    out, or of another dimension, are not in the index; equal vectors lie in one list, which may be of any size, as rows are dealt by
    ranges of list and id. An empty table gives an index without lists.
    """
    v = write_table(usable(vectors, "chunk_id").filter(F.size("unit") == dim), "vectors")
    n = v.count()
    h = F.xxhash64(F.lit(seed), F.col("key"))
    unit = F.shiftrightunsigned(h, 11) / float(1 << 53)
    drawn = v.filter(unit <= min(1.0, 2 * SAMPLE_VECTORS / max(n, 1))).withColumn("h", h).orderBy("h", "key", "unit").limit(SAMPLE_VECTORS)
    sample = np.array([r["unit"] for r in drawn.select("unit").collect()]).reshape(-1, dim)  # SAMPLE_VECTORS at most
    lists, rng = min(lists or max(1, round(n**0.5)), MOST_LISTS, len(sample)), np.random.default_rng(seed)
    if learn:
        centroids = _learn(sample, lists, rng) if lists else np.zeros((0, dim))
    else:
        axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        centroids = np.concatenate([axes, -axes])
    probes, held = _probes_for(sample, centroids, k, recall, rng) if lists else (0, 1.0)
    index = InvertedLists(centroids, probes, held)
    placed = _assigned(v, centroids, 1).select(F.col("parts")[0].alias("part"), "key", "unit")
    dealt = placed.repartitionByRange("part", "key").sortWithinPartitions("part")
    index.table = write_table(dealt, "lists")
    return index


def _assigned(df: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """df (key, unit) with parts, the n nearest lists."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if batch.num_rows and n:
                closeness = _matrix(batch.column("unit"), batch.num_rows) @ c.T
                near = np.argsort(-closeness, axis=1, kind="stable")[:, :n] if n > 1 else closeness.argmax(axis=1)[:, None]
                parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("unit"), parts], ["key", "unit", "parts"])

    return df.select("key", "unit").mapInArrow(run, "key long, unit array<double>, parts array<int>")


def search_lists(index: InvertedLists, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: the k nearest of each query (query_id, embedding) among the vectors of the lists nearest to it.

    Only the lists that some query probes are read. Approximate: probes of all lists would make it exact. Queries that usable() leaves
    out, or of another dimension, have no rows.
    """
    dim, probes = index.centroids.shape[1], min(probes or index.probes, len(index.centroids))
    asked = write_table(_assigned(usable(queries, "query_id").filter(F.size("unit") == dim), index.centroids, probes), "list-queries")
    probed = [r[0] for r in asked.select(F.explode("parts").alias("p")).distinct().collect()]  # MOST_LISTS at most
    return _nearest(index.table.filter(F.col("part").isin(probed)), asked, k)


def vector_search_lsh(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """Approximate search in lists by hashing alone, nothing learned but how many to probe; see build_lists and search_lists."""
    return search_lists(build_lists(vectors, dim, k, learn=False), queries, k)


def probed_share(index: InvertedLists, queries: DataFrame) -> DataFrame:
    """query_id, share: the share of all vectors that a query is compared with."""
    dim = index.centroids.shape[1]
    sizes = index.table.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    asked = _assigned(usable(queries, "query_id").filter(F.size("unit") == dim), index.centroids, index.probes)
    met = asked.select(F.col("key").alias("query_id"), F.explode("parts").alias("part")).join(F.broadcast(sizes), "part")
    return met.groupBy("query_id").agg((F.sum("n") / F.lit(max(1, index.table.count()))).alias("share"))


# --- the offline model ---------------------------------------------------------------------------------------------------------


@functools.lru_cache(1 << 16)
def _place(word: str, dim: int) -> int:
    import hashlib

    return int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % dim


def hashed_embeddings(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """Offline default of the embedder: normalized counts of words by the first two hex digits of their MD5, over the whole text. Null or blank texts count as [empty].

    A row's words are counted where it lies: nothing is shuffled, and an MD5 is taken once a batch for each different word.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            coded = words.flatten().dictionary_encode()
            places = np.array([_place(w, dim) for w in coded.dictionary.to_pylist()], np.int64)
            at = places[coded.indices.to_numpy(zero_copy_only=False)] if len(owner) else np.zeros(0, np.int64)
            raw = np.bincount(owner * dim + at, minlength=batch.num_rows * dim).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(raw))], ["key", "raw"])

    words = df.select(F.col(key).alias("key"), T.word_tokens(T.sanitize_embed_input(text, None)).alias("words"))
    return words.mapInArrow(run, f"key {kind}, raw array<double>").select(F.col("key").alias(key), T.l2_normalize("raw").alias("embedding"))
