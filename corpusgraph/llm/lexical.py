"""Ranked lexical search: bit-sliced Bloom signatures give upper bounds of scores, and only documents they cannot exclude are rescored."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ragged, text_slices, texts, write_table
from .decontam import words_of

#: Bytes of text, and documents, that one block of signatures covers at most.
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 2048
#: Bits of a signature for each of its entries (up to twice as many, as lengths are powers of two), and bits that an entry sets.
ENTRY_BITS, PROBES = 16, 5
#: Words of search items that are broadcast at a time; more items are searched in several passes.
BROADCAST_WORDS = 1_000_000
#: Distinct terms of the items that a task scores at a time.
GROUP_TERMS = 4096
#: Candidates that are broadcast to the rescoring; more are joined by shuffling.
BROADCAST_CANDIDATES = 500_000
#: Documents of the highest bounds that are scored first, as a multiple of k.
FIRST = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def probes(hashes: np.ndarray, tier: int, exponent: int) -> np.ndarray:
    """(entries, PROBES): the bits, of 2**exponent, that the entries (term, tier) set; hashes are the terms'."""
    h = _mixed(hashes + np.uint64(tier * int(_ODD) % (1 << 64)))
    step = _mixed(h ^ _ODD) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) >> np.uint64(64 - exponent)).astype(np.int64)


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 0)


@dataclass
class Asked:
    """The terms of a block of search items; a broadcast holds BROADCAST_WORDS words of them about."""

    ids: list
    vocab: dict = field(default_factory=dict)  # term: its number
    terms: list = field(default_factory=list)  # term numbers of each item
    hashes: np.ndarray = None
    weights: np.ndarray = None
    docs: int = 0  # documents with a term
    words: int = 0  # their terms, with repeats

    @classmethod
    def of(cls, rows: list[tuple]) -> Asked:
        own = cls([i for i, _ in rows])
        for _, text in rows:
            own.terms.append(np.unique(np.array([own.vocab.setdefault(w, len(own.vocab)) for w in words_of(text)], np.int64)))
        own.hashes = np.fromiter((term_hash(t) for t in own.vocab), np.uint64, len(own.vocab))
        return own

    def weighed(self, docs: int, words: int, found: dict[int, int]) -> Asked:
        """With the corpus' counts and the weight of each term; found: documents that hold a term."""
        w = [math.floor(1000 * math.log((2 * docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(self.vocab))]
        return Asked(self.ids, self.vocab, self.terms, self.hashes, np.array(w, np.int64), docs, words)

    def length_part(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n * self.docs // self.words

    def groups(self) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
        """Items in groups of GROUP_TERMS distinct terms about: the terms, and for each item where its own stand among them."""
        at, n = 0, len(self.terms)
        while at < n:
            stop, size = at, 0
            while stop < n and (stop == at or size + len(self.terms[stop]) <= GROUP_TERMS):
                size, stop = size + len(self.terms[stop]), stop + 1
            terms = np.unique(np.concatenate(self.terms[at:stop]))
            yield terms, [(i, np.searchsorted(terms, self.terms[i])) for i in range(at, stop) if len(self.terms[i])]
            at = stop

    def score(self, counts: Counter, n: int, item: int, names: list[bytes]) -> int:
        m = 10 + 90 * n * self.docs // self.words
        total = 0
        for t in self.terms[item].tolist():
            if tf := counts.get(names[t], 0):
                total += int(self.weights[t]) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        return total


def signatures(docs: DataFrame, asked) -> DataFrame:
    """Rows of the index: blocks of documents of like size with their bit slices, and counts of the asked terms.

    docs: doc_id, h (a hash of the text), text. A document's signature has an entry for each term and for each power of two (a tier)
    that the term's frequency reaches; its length is a power of two, ENTRY_BITS bits an entry at least. A block holds documents of one
    length: doc_ids, hs, ns (terms with repeats), exponent (of the length), tiers, slices (for each bit a row of one bit a document).
    The first row of a slice of text has terms and found besides: asked terms, and the documents that hold them. Documents without
    terms are in no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = asked.value.vocab
        known = vocab.keys()
        for batch in text_slices(batches, "text", BLOCK_BYTES):
            ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            where, ns, hashes, tfs, owner, found = [], [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                words = words_of(text)
                if not words:
                    continue
                counts = Counter(words)
                hashes.append(np.fromiter(map(term_hash, counts), np.uint64, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
                owner.append(np.full(len(counts), len(where)))
                found += [vocab[t] for t in counts.keys() & known]
                where.append(i)
                ns.append(len(words))
            if not where:
                continue
            terms, n_found = np.unique(np.array(found, np.int64), return_counts=True)
            h, tf, doc = np.concatenate(hashes), np.concatenate(tfs), np.concatenate(owner)
            top = np.frexp(tf)[1] - 1  # the highest tier
            entries = np.bincount(doc, top + 1, len(where))
            exponents = np.maximum(6, np.ceil(np.log2(ENTRY_BITS * entries)).astype(np.int64))
            rows = []
            for exponent in np.unique(exponents).tolist():
                members = np.flatnonzero(exponents == exponent)
                for start in range(0, len(members), BLOCK_DOCS):
                    mine = members[start : start + BLOCK_DOCS]
                    column = np.full(len(where), -1)
                    column[mine] = np.arange(len(mine))
                    own = column[doc] >= 0
                    bits, tiers = np.zeros((1 << exponent, len(mine)), bool), int(top[own].max()) + 1
                    for tier in range(tiers):
                        has = own & (top >= tier)
                        bits[probes(h[has], tier, exponent), column[doc[has]][:, None]] = True
                    rows.append((mine, exponent, tiers, np.packbits(bits, axis=1).tobytes()))
            pick = lambda values, kind: pa.array([[values[i] for i in mine] for mine, *_ in rows], pa.list_(kind))
            first = [np.zeros(0, np.int64)] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pick([ids[i] for i in where], pa.int64()), pick([hs[i] for i in where], pa.int64()), pick(ns, pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.binary()), ragged([terms, *first], pa.int64()), ragged([n_found, *first], pa.int64()),
                ],
                ["doc_ids", "hs", "ns", "exponent", "tiers", "slices", "terms", "found"],
            )

    return docs.mapInArrow(run, "doc_ids array<long>, hs array<long>, ns array<long>, exponent int, tiers int, slices binary, terms array<long>, found array<long>")


def upper_bounds(asked: Asked, batch: pa.RecordBatch, row: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each item, the upper bounds of the scores of a block's documents: the sums of what their slices say of its terms, weighted."""
    n = batch.column("ns")[row].values.to_numpy()
    exponent, tiers = batch.column("exponent")[row].as_py(), batch.column("tiers")[row].as_py()
    slices = np.frombuffer(batch.column("slices")[row].as_buffer(), np.uint8).reshape(1 << exponent, -1)
    m = asked.length_part(n)
    # a term of tier j stands less than 2**(j + 1) times, and no more often than the document has terms
    most = [np.minimum((2 << tier) - 1, n) for tier in range(tiers)]
    parts = [(1_000_000_000 * c // (1000 * c + 8 * m)).astype(np.int32) for c in most]
    for terms, items in asked.groups():
        value, has, live = np.zeros((len(terms), len(n)), np.int32), None, np.arange(len(terms))
        for tier in range(tiers):
            bits = np.bitwise_and.reduce(slices[probes(asked.hashes[terms[live]], tier, exponent)], axis=1)
            bits = bits if has is None else bits & has
            some = bits.any(axis=1)
            live, has = live[some], bits[some]
            if not len(live):
                break
            on = np.unpackbits(has, axis=1, count=len(n)).view(bool)
            value[live] = np.where(on, parts[tier], value[live])
        weights = asked.weights[terms]
        for item, at in items:
            yield item, weights[at] @ value[at]


def _best(ids: np.ndarray, missing: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest bounds, ties to the smaller id, missing ids last."""
    if len(ids) > k:
        cut = np.partition(bounds, len(bounds) - k)[len(bounds) - k]
        near = np.flatnonzero(bounds >= cut)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], missing[near], -bounds[near]))][:k]


def _ids(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids of a block (0 where there is none), and which are missing."""
    values = batch.column("doc_ids")[row].values
    missing = values.is_null().to_numpy(zero_copy_only=False)
    return values.fill_null(0).to_numpy(zero_copy_only=False), missing


CANDIDATE = "item int, doc_id long, h long, bound long"


def _candidates(rows: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
    ids = pa.array(cols[1], pa.int64(), mask=cols[2])
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), ids, pa.array(cols[3]), pa.array(cols[4])], ["item", "doc_id", "h", "bound"])


def most_promising(index: DataFrame, asked, k: int) -> DataFrame:
    """item, doc_id, h, bound: the k documents of the highest upper bounds of each item; a task gives k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = asked.value, {}
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, missing), hs = _ids(batch, row), batch.column("hs")[row].values.to_numpy()
                for item, bounds in upper_bounds(own, batch, row):
                    old = kept.get(item)
                    near = np.flatnonzero(bounds >= (old[3].min() if old is not None and len(old[3]) == k else 1))
                    if len(near):
                        new = [x[near] for x in (ids, missing, hs, bounds)]
                        new = [np.concatenate(x) for x in zip(old, new, strict=True)] if old is not None else new
                        best = _best(new[0], new[1], new[3], k)
                        kept[item] = [x[best] for x in new]
        if kept:
            yield _candidates([(np.full(len(x[0]), item), *x) for item, x in kept.items()])

    found = index.mapInArrow(run, CANDIDATE)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def not_excluded(index: DataFrame, asked, least: dict[int, tuple], k: int) -> DataFrame:
    """item, doc_id, h, bound: all documents whose upper bound reaches the k-th score known so far (least: item to score and id).

    A bound equal to that score counts for smaller ids only. Of equal texts, which score alike, the k smallest ids are all that can
    matter.
    """
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, need = asked.value, sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, missing), hs = _ids(batch, row), batch.column("hs")[row].values.to_numpy()
                out = []
                for item, bounds in upper_bounds(own, batch, row):
                    score, last = need.get(item, (0, None))
                    near = np.flatnonzero((bounds > score) | ((bounds == score) & (score > 0) & ((last is None) | (~missing & (ids <= (last or 0))))))
                    if len(near) > k:
                        near = near[np.lexsort((ids[near], missing[near], hs[near]))]
                        first = np.concatenate([[True], hs[near][1:] != hs[near][:-1]])
                        nth = np.arange(len(near)) - np.maximum.accumulate(np.where(first, np.arange(len(near)), 0))
                        near = near[nth < k]
                    if len(near):
                        out.append((np.full(len(near), item), ids[near], missing[near], hs[near], bounds[near]))
                if out:
                    yield _candidates(out)

    rank = F.row_number().over(Window.partitionBy("item", "h").orderBy(F.col("doc_id").asc_nulls_last()))
    return index.mapInArrow(run, CANDIDATE).withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def rescored(docs: DataFrame, asked, candidates: DataFrame) -> DataFrame:
    """item, doc_id, score: exact scores of the candidates (a table), from their whole texts."""
    wanted = candidates.groupBy(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h")).agg(F.collect_set("item").alias("items"))  # as many items as are broadcast at most
    if candidates.count() <= BROADCAST_CANDIDATES:
        wanted = F.broadcast(wanted)
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h"))).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        names = list(own.vocab)
        for batch in text_slices(batches, "text"):
            ids, items, out = batch.column("doc_id").to_pylist(), batch.column("items").to_pylist(), []
            for doc_id, mine, text in zip(ids, items, texts(batch), strict=True):
                words = words_of(text)
                counts = Counter(words)
                out += [(item, doc_id, own.score(counts, len(words), item, names)) for item in mine]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return met.mapInArrow(run, "item int, doc_id long, score long").filter("score > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text), exactly.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Equal scores go by doc_id, null last.
    Items that are null or without terms have no rows, items of one id and text are one item, those of one id and different texts are
    ranked apart; documents that are null or without terms count nowhere; repeated documents are documents of their own (so one
    doc_id may rank twice). Empty tables give no rows.

    The index (signatures) is one pass over the texts and holds every document. Items are broadcast in blocks of BROADCAST_WORDS
    words. FIRST times k documents of the highest bounds are scored first; their k-th score excludes every document whose bound is lower.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").filter(F.col("text").isNotNull())
    usable = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * BROADCAST_WORDS)))  # a word and what parts it have two characters at least
    out = []
    for block in range(blocks):
        mine = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        out.append(_search_block(spark, docs, sorted(((r[0], r[1].encode()) for r in mine), key=lambda r: (r[0] is None, r[0] or 0, r[1])), k))
    return functools.reduce(DataFrame.unionByName, out)


def _search_block(spark: SparkSession, docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    asked, sc = Asked.of(rows), spark.sparkContext
    index = write_table(signatures(docs, sc.broadcast(asked)), "bloom-index")
    size = index.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    # a row for each asked term
    found = {r["t"]: r["n"] for r in index.select(F.explode(F.arrays_zip("terms", "found")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.found").alias("n")).collect()}
    asked = asked.weighed(size[0] or 0, size[1] or 1, found)
    sent = sc.broadcast(asked)
    blocks = index.drop("terms", "found")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    first = ranked(rescored(docs, sent, write_table(most_promising(blocks, sent, FIRST * k), "bloom-first")))
    least = {r["item"]: (r["score"], r["doc_id"]) for r in first.filter(F.col("rank") == k).collect()}  # a row for each item
    all_ = write_table(not_excluded(blocks, sent, least, k), "bloom-candidates")
    names = spark.createDataFrame([(i, item) for i, item in enumerate(asked.ids)], "n int, item_id long")
    return ranked(rescored(docs, sent, all_)).join(F.broadcast(names), F.col("item") == F.col("n")).select("item_id", "rank", "doc_id", "score")


def benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
s AS MATERIALIZED (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
i AS MATERIALIZED (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
a AS MATERIALIZED (SELECT DISTINCT t FROM i),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) SEMI JOIN a USING (t) GROUP BY doc_id, n, t),
g AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
f AS MATERIALIZED (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)) AS part FROM p, s),
c AS (SELECT item_id, doc_id, CAST(sum(wt * part) AS BIGINT) AS score FROM i JOIN g USING (t) JOIN f USING (t) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
