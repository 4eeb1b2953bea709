"""Benchmark decontamination: rare n-gram seeds of test items locate passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts

#: Words of a seed; of every STRETCH consecutive n-grams of an item the one rarest in the corpus is a seed.
SEED_WORDS, STRETCH = 4, 2
#: Words of test items that are broadcast at a time; more items are searched in several passes.
BROADCAST_WORDS = 1_000_000
#: Share of an item's words (matches less edits) from which a passage counts.
MIN_SCORE = 0.45

# Words are lower-cased runs of letters and digits; other ASCII parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def local_alignment(passage: np.ndarray, item: np.ndarray, match: int = 1, edit: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman: the best score of aligning part of the passage with part of the item, and where (start, end) it stands in the passage.

    Rows go over the item, a row is filled at once: gaps along the row are a running maximum. Ids below 1 match nothing.
    """
    n = len(passage)
    at = np.arange(n + 1) * edit
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item.tolist():
        step = np.where(passage == w, match, -edit) if w > 0 else np.full(n, -edit)
        new, come = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diagonal = row[:-1] + step
        up = row[1:] - edit
        take = diagonal >= up
        new[1:] = np.where(take, diagonal, up)
        come[1:] = np.where(take, origin[:-1], origin[1:])
        low = new <= 0
        new[low], come[low] = 0, np.arange(n + 1)[low]
        lifted = new + at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        across = top - at
        more = across > new
        come = np.where(more, come[source], come)
        row, origin = np.maximum(new, across), come
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
    return best


@dataclass
class Items:
    """Test items as word ids, and their n-grams; a broadcast holds BROADCAST_WORDS words of them about."""

    ids: list
    vocab: dict = field(default_factory=dict)
    words: list = field(default_factory=list)
    grams: dict = field(default_factory=dict)  # key: index into places
    places: list = field(default_factory=list)  # [(item index, offset)]
    keys: np.ndarray = None

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        own = cls([i for i, _ in rows])
        for index, (_, text) in enumerate(rows):
            ids = np.array([own.vocab.setdefault(w, len(own.vocab) + 1) for w in words_of(text)], np.int64)
            own.words.append(ids)
            for at, key in enumerate(gram_keys(ids).tolist()):
                k = own.grams.setdefault(key, len(own.places))
                if k == len(own.places):
                    own.places.append([])
                own.places[k].append((index, at))
        own.keys = np.array(sorted(own.grams), np.uint64)
        return own

    def seeded(self, counts: dict[int, int]) -> Items:
        """With only the seeds kept: of every STRETCH consecutive n-grams of an item the one in fewest documents (the first on a tie)."""
        keep = defaultdict(set)
        for index, ids in enumerate(self.words):
            keys = gram_keys(ids).tolist()
            for at in range(max(1, len(keys) - STRETCH + 1)):
                if run := keys[at : at + STRETCH]:
                    j = min(range(len(run)), key=lambda j: (counts.get(self.grams[run[j]], 0), j))
                    keep[run[j]].add((index, at + j))
        grams = {k: i for i, k in enumerate(sorted(keep))}
        return Items(self.ids, self.vocab, self.words, grams, [sorted(keep[k]) for k in sorted(keep)], np.array(sorted(keep), np.uint64))

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.vocab.get
        words = words_of(text)
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a document n-grams of the items stand, and which."""
        if len(ids) < SEED_WORDS or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        run = known[: len(ids) - SEED_WORDS + 1].copy()
        for j in range(1, SEED_WORDS):
            run &= known[j : len(ids) - SEED_WORDS + 1 + j]
        at = np.flatnonzero(run)
        if not len(at):
            return at, at
        keys = _keys([ids[at + j] for j in range(SEED_WORDS)])
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[slot] == keys
        return at[found], keys[found]

    def passages(self, ids: np.ndarray, min_score: float, cache: dict) -> list[tuple]:
        """(item index, score, start, words, places) of each item found in a document; the best place counts, the first on a tie."""
        at, keys = self.hits(ids)
        diagonals = defaultdict(set)
        for p, key in zip(at.tolist(), keys.tolist(), strict=True):
            for index, offset in self.places[self.grams[key]]:
                diagonals[index].add(p - offset)
        out = []
        for index, starts in sorted(diagonals.items()):
            item = self.words[index]
            slack = len(item) // 3 + 2
            spans = []
            for s in sorted(starts):
                a, b = max(0, s - slack), min(len(ids), s + len(item) + slack)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            least, found = min_score * len(item), []
            for a, b in spans:
                passage = ids[a:b]
                if np.isin(passage, item).sum() < least:
                    continue
                key = (index, passage.tobytes())
                if (hit := cache.get(key)) is None:
                    if len(cache) > 20_000:
                        cache.clear()
                    hit = cache[key] = local_alignment(passage, item)
                if hit[0] >= least:
                    found.append((-hit[0] / len(item), a + hit[1], hit[2] - hit[1]))
            if found:
                score, start, n = min(found)
                out.append((index, -score, start, n, len(found)))
        return out


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def gram_keys(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - SEED_WORDS + 1
    return _keys([ids[j : j + n] for j in range(SEED_WORDS)]) if n > 0 else np.zeros(0, np.uint64)


def item_blocks(docs: DataFrame, items: DataFrame) -> Iterator:
    """Broadcasts of the items' seeds, each of about BROADCAST_WORDS words; document counts of their n-grams are over all documents."""
    sc = docs.sparkSession.sparkContext
    usable = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", F.length("text").alias("n"))
    total = usable.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (5 * BROADCAST_WORDS)))  # five characters a word at least, about
    for block in range(blocks):
        mine = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").distinct()
        rows = sorted(((r[0], r[1].encode()) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent = sc.broadcast(Items.of(rows))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sums = np.zeros(len(own.keys), np.int64)
            for batch in text_slices(batches, "text"):
                for text in texts(batch):
                    if len(keys := own.hits(own.numbers(text))[1]):
                        sums[np.searchsorted(own.keys, np.unique(keys))] += 1
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["slot", "n"])

        counted = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # a row for each n-gram of the block
        own = sent.value
        counts = {own.grams[int(own.keys[r["slot"]])]: r["n"] for r in counted}
        yield sc.broadcast(own.seeded(counts))


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, start_word, n_words, n_places.

    score is the best alignment's matches less edits over the item's words (1 for a whole exact copy). Case and punctuation do not
    count. Items (or texts) that are null or under SEED_WORDS words are never found; repeated documents each get their rows, items of
    one id and text are one; ids may be null; empty tables give no rows.
    """
    out = None
    for sent in item_blocks(docs, items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, cache = sent.value, {}
            for batch in text_slices(batches, "text"):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, texts(batch), strict=True):
                    rows += [(doc_id, own.ids[x[0]], *x[1:]) for x in own.passages(own.numbers(text), min_score, cache)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "n_words", "n_places"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, start_word long, n_words long, n_places long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents (all their columns) that hold no test item; see leaks."""
    for sent in item_blocks(docs, items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, cache = sent.value, {}
            for batch in text_slices(batches, "text"):
                yield batch.filter(pa.array([not own.passages(own.numbers(t), min_score, cache) for t in texts(batch)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
