"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Vectors of a candidate block (whose sorted lists one task reads) and of a query block.
BLOCK_ROWS, QUERY_ROWS = 8192, 512
#: Part of a list that is read first; each further step doubles what is read.
FIRST_STEP = 32
#: Query blocks for which a task sorts the lists of a candidate block once.
QUERY_BLOCKS = 64


class SortedLists:
    """A block of candidates (rows, dimensions) with each dimension sorted by value, once for all queries."""

    def __init__(self, values: np.ndarray):
        self.values = values
        order = np.argsort(values, axis=0, kind="stable")
        self.place = np.empty(order.shape, np.int32)  # from the bottom
        np.put_along_axis(self.place, order, np.arange(len(values), dtype=np.int32)[:, None], axis=0)
        self.ascending = np.take_along_axis(values, order, axis=0)


def nra_top(lists: SortedLists, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, rows of the block among which are all its k best (with all ties of the k-th), and their scores.

    A list is read from its top for positive weights of the query and from its bottom for negative ones, twice as deep at each step.
    A candidate's lower bound takes the worst value of the lists in which it is not met yet, and only what a step reads is added to
    it; its upper bound takes the value at the depth reached. A candidate whose upper bound is below the k-th lower bound is out,
    met or not, and is read no further. Once no others than k can qualify, the rest of the lists is read for those, which closes
    their bounds. Values are integers, kept in doubles, so sums below 2**53 are exact.
    """
    n = len(lists.values)
    low, high = lists.ascending[0], lists.ascending[-1]
    plus, minus = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    open_, rows, out = np.arange(len(queries)), np.arange(n), [None] * len(queries)
    lower = np.repeat((plus @ low + minus @ high)[:, None], n, axis=1)
    read, t = 0, max(1, n // FIRST_STEP)
    while len(open_):
        t, place, values = min(n, t), lists.place[rows], lists.values[rows]
        above, below, p, m = values - low, values - high, plus[open_], minus[open_]
        new_top, new_bottom = (place >= n - t) & (place < n - read), (place < t) & (place >= read)
        lower += p @ np.where(new_top, above, 0.0).T + m @ np.where(new_bottom, below, 0.0).T
        unmet_top, unmet_bottom = place < n - t, place >= t
        if t < n:
            reach = (p * (lists.ascending[n - t] - low)) @ unmet_top.T + (m * (lists.ascending[t - 1] - high)) @ unmet_bottom.T
        else:
            reach = 0.0
        kth = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(open_), -np.inf)
        alive = lower + reach >= kth[:, None]
        done = (alive.sum(axis=1) <= 2 * k) | (t == n)
        for i in np.flatnonzero(done).tolist():
            mine = np.flatnonzero(alive[i])
            rest = np.where(unmet_top[mine], above[mine], 0.0) @ p[i] + np.where(unmet_bottom[mine], below[mine], 0.0) @ m[i]
            out[open_[i]] = rows[mine], lower[i, mine] + rest
        keep = alive[~done].any(axis=0) if not done.all() else np.zeros(len(rows), bool)
        open_, lower, rows = open_[~done], lower[~done][:, keep], rows[keep]
        read, t = t, 2 * t
    return out


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(1024 * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query (vec_id, v) with every other row of vectors.

    Ties go to the smaller vec_id (null last). Rows whose vec_id is a query's own are none of its candidates. Only vectors of equal
    length are compared (the score of empty ones is 0). Equal vectors are one candidate with its k + 1 smallest distinct ids, each
    as often as it is given (k times at most), which is all that can matter once a query's own id is taken out. A query row given twice counts once; a query without an id takes no part; empty tables give no rows.

    Candidates are packed into blocks of BLOCK_ROWS vectors and queries into blocks of QUERY_ROWS; each pair of blocks is a row, and
    rows of one candidate block are dealt so that its lists are sorted once for QUERY_BLOCKS of them. A block gives k rows (besides
    the query's own) for each query, which a second step merges. On dense vectors of many dimensions most of each list has to be
    read before the bounds part, so this costs more than a product of the whole block would.
    """
    spark = vectors.sparkSession
    by_vector = Window.partitionBy("v", "salt").orderBy(F.col("vec_id").asc_nulls_last())
    # equal vectors meet in two steps, so that one vector's many ids are cut down in many tasks first
    ids = vectors.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    cut = ids.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1).drop("r", "salt")
    same = cut.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("null"), "vec_id", "n"))), 1, k + 1).alias("ids"))
    same = write_table(same.select("v", F.size("v").alias("d"), F.flatten(F.transform("ids", lambda x: F.array_repeat(x.vec_id, x.n))).alias("ids"), F.xxhash64("v").alias("h")), "top-candidates")
    asked = queries.filter("vec_id is not null").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("vec_id").alias("h"))
    asked = write_table(asked, "top-queries")

    def numbered(df: DataFrame, rows: int):
        """How many blocks the rows of each vector length make."""
        counts = {r["d"]: r["n"] for r in df.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each vector length
        return F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // rows))]) if counts else F.create_map(F.lit(0), F.lit(1))

    def packed(df: DataFrame, blocks, names: str) -> DataFrame:
        dealt = df.withColumn("block", F.pmod("h", blocks[F.col("d")]).cast("int"))
        return dealt.groupBy("d", "block").agg(F.collect_list(F.struct(*names.split())).alias("rows"))

    c_blocks = numbered(same, BLOCK_ROWS)
    c = packed(same, c_blocks, "v ids").select("d", F.col("block").alias("c_block"), F.col("rows").alias("c_rows"))
    q = packed(asked, numbered(asked, QUERY_ROWS), "v vec_id").select("d", F.floor(F.col("block") / QUERY_BLOCKS).alias("q_part"), F.col("rows").alias("q_rows"))
    # query blocks are copied to each candidate block: they meet by its number, not by the vectors' length alone
    q = q.withColumn("c_block", F.explode(F.sequence(F.lit(0), c_blocks[F.col("d")] - 1)))
    pairs = c.join(q, ["d", "c_block"]).repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "d", "c_block", "q_part").sortWithinPartitions("d", "c_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                d, block = batch.column("d")[row].as_py(), batch.column("c_block")[row].as_py()
                cand, ask = batch.column("c_rows")[row].values, batch.column("q_rows")[row].values
                matrix = lambda s: s.field("v").flatten().to_numpy().reshape(len(s), d).astype(float)
                if (d, block) != now:
                    now, lists = (d, block), SortedLists(matrix(cand)) if d else None
                ids, qs, names = cand.field("ids"), matrix(ask), ask.field("vec_id").to_pylist()
                heads, flat = ids.offsets.to_numpy(), ids.values.to_pylist()
                asking = set(names)
                own = max(Counter(x for x in flat if x in asking).values(), default=0)  # so many more, for the query's own vectors
                best = nra_top(lists, qs, k + own) if d else [(np.arange(len(cand)), np.zeros(len(cand)))] * len(qs)
                out = []
                for name, (found, scores) in zip(names, best, strict=True):
                    rows = [(int(s), x) for s, c in zip(scores, found.tolist(), strict=True) for x in flat[heads[c] : heads[c + 1]] if x != name]
                    rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
                    out += [(name, x, s) for s, x in rows[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embeddings_top_k(vectors: DataFrame, k: int = 10) -> DataFrame:
    """top_k of every vector whose vec_id is divisible by 100 against all."""
    v = quantized(vectors)
    return top_k(v, v.filter("vec_id % 100 = 0"), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
