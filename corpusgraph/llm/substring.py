"""Substring dedup: spans of words that occur earlier in the corpus, found by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts, write_table

#: Words of the k-grams among which a window's anchor, the one of the smallest hash, is chosen.
ANCHOR_WORDS = 6
#: Different strings of one anchor that an automaton takes; those of more frequent anchors are compared window by window.
AUTOMATON_STRINGS = 2000
#: Anchored runs that a Python worker holds before it hands them on.
HELD_RUNS = 500_000
#: Repeats found by the worker that handed them on go in pieces of so many.
GONE_RUNS = 1 << 14
#: Shards for each shuffle partition.
SHARDS_EACH = 4

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of a sequence of word hashes, by sums of powers modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]):
        self.back, powers = np.full((2, len(words) + 1), base, np.uint64)
        self.back[:] = pow(base, -1, 1 << 64)
        self.back[0] = powers[0] = 1
        np.cumprod(self.back, out=self.back)
        np.cumprod(powers, out=powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return _mixed((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] + np.asarray(lengths).astype(np.uint64) * np.uint64(_BASES[1]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchored_runs(words: np.ndarray, doc_ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor value: (anchor, key of the run's words, document, start in the concatenation, windows, whether the anchor stands in it more than once)."""
    n = len(words)
    k = min(ANCHOR_WORDS, window)
    empty = np.zeros(0, np.int64)
    nothing = empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty > 0
    if n < window:
        return nothing
    span = SpanHash(words)
    grams = least = span.of(np.arange(n - k + 1), k)
    wide, done = window - k + 1, 1
    while done < wide:  # minima over `done` k-grams grow to `wide`
        step = min(done, wide - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    doc = np.searchsorted(doc_ends, np.arange(n - window + 1), "right")
    at = np.flatnonzero(np.arange(window, n + 1) <= doc_ends[doc])
    if not len(at):
        return nothing
    value, owner = least[at], doc[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    inside = count + window - k  # k-grams of a run
    ends = np.cumsum(inside)
    spot = np.arange(ends[-1]) + np.repeat(start - ends + inside, inside)
    again = np.add.reduceat((grams[spot] == np.repeat(value[first], inside)).astype(np.int32), ends - inside) > 1
    return value[first], span.of(start, count + window - 1), owner[first], start, count, again


class SuffixAutomaton:
    """Suffix automaton of several strings, built online, with matching statistics of each string against all that came before."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def feed(self, string: list[int], least: int) -> list[int]:
        """Add a string; the positions where a substring of `least` elements ends that also ends earlier (in a string before, or in this one)."""
        nexts, links, lens = self.next, self.link, self.len
        last, state, length, found = 0, 0, 0, []
        for at, c in enumerate(string):
            # matching statistics against what is in the automaton now
            while state and c not in nexts[state]:
                state = links[state]
                length = lens[state]
            if c in nexts[state]:
                state = nexts[state][c]
                length += 1
            if length >= least:
                found.append(at)
            # extension by c
            p = last
            if c in nexts[p]:
                q = nexts[p][c]
                last = q if lens[p] + 1 == lens[q] else self._clone(p, q, c)
            else:
                new = len(nexts)
                nexts.append({})
                links.append(0)
                lens.append(lens[p] + 1)
                while p >= 0 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = links[p]
                if p >= 0:
                    q = nexts[p][c]
                    links[new] = q if lens[p] + 1 == lens[q] else self._clone(p, q, c)
                last = new
            while state and length <= lens[links[state]]:  # the state may have been split
                state = links[state]
        return found

    def _clone(self, p: int, q: int, c: int) -> int:
        nexts, links, lens = self.next, self.link, self.len
        new = len(nexts)
        nexts.append(dict(nexts[q]))
        links.append(links[q])
        lens.append(lens[p] + 1)
        links[q] = new
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = links[p]
        return new


def _split(docs: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [t.split() for t in docs]
    ends = np.cumsum([len(w) for w in words])
    return words, (np.concatenate([word_hashes(w) for w in words]) if words else np.zeros(0, np.uint64)), ends


def _in_order(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (anchor, run, doc_id, null, h, start, ...): their order by run and place; where in it runs begin; where places later than a run's first stand.

    The first place given again (by a row given twice) is neither.
    """
    anchor, key, doc_id, null, h, start = cols[:6]
    by = np.lexsort((start, h, doc_id, null, key, anchor))
    anchor, key, doc_id, null, h, start = (x[by] for x in cols[:6])
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])]) if len(by) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0)) if len(by) else by
    later = (doc_id != doc_id[head]) | (null != null[head]) | (h != h[head]) | (start != start[head])
    return by, np.flatnonzero(first), np.flatnonzero(later)


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, h (hash of the text), start, n: from word `start` on, n windows that also start earlier."""
    spark = docs.sparkSession
    shards = SHARDS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")

    # 1. Anchored runs of every document, as packed columns for each shard of anchors.
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            by, first, later = _in_order(cols)
            # of the places of one run only the first goes to its shard; the later ones are repeats, dealt to any partition
            gone = [x[by[later]] for x in cols]
            anchor, key, doc_id, null, h, start, n, again = (x[by[first]] for x in cols)
            for i in range(0, len(later), GONE_RUNS):
                blobs = [pa.array([x[i : i + GONE_RUNS].tobytes()], pa.binary()) for x in gone]
                spread = shards + xxhash.xxh32_intdigest(blobs[2][0].as_py()) % (1 << 20)
                yield pa.RecordBatch.from_arrays([pa.array([spread], pa.int32()), *blobs], ["shard", *PACKED])
            shard = (anchor >> np.uint64(40)).astype(np.int64) % shards
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            for part in np.array_split(some, max(1, len(some) // 256)):
                pick = [by[cuts[s] : cuts[s + 1]] for s in part]
                blob = lambda x: pa.array([x[p].tobytes() for p in pick], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *map(blob, (anchor, key, doc_id, null, h, start, n, again))], ["shard", *PACKED])

        for batch in text_slices(batches, "text"):
            _, words, ends = _split(texts(batch))
            anchor, key, owner, start, n, again = anchored_runs(words, ends, window)
            ids = batch.column("doc_id")
            doc_id, null, h = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("h").to_numpy()
            begin = ends - np.diff(np.concatenate([[0], ends])) if len(ends) else ends
            held.append((anchor, key, doc_id[owner], null[owner], h[owner], (start - begin[owner]).astype(np.int32), n.astype(np.int32), again))
            count += len(anchor)
            if count >= HELD_RUNS:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    PACKED = ("anchor", "run", "doc_id", "null", "h", "start", "n", "again")
    packed = narrow.mapInArrow(runs, "shard int, " + ", ".join(f"{c} binary" for c in PACKED)).repartition("shard")

    # 2. Runs of equal words: all but the first are repeats. The first runs of an anchor with several, or of a run that may repeat itself, are asked for.
    kinds = (np.uint64, np.uint64, np.int64, np.bool_, np.int64, np.int32, np.int32, np.bool_)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in PACKED]
            for i, s in enumerate(batch.column("shard").to_pylist()):
                held.setdefault(s, []).append([np.frombuffer(c[i], k) for c, k in zip(cols, kinds, strict=True)])
        for s in sorted(held):
            cols = [np.concatenate(x) for x in zip(*held.pop(s), strict=True)]
            yield from _compare(cols) if s < shards else _result(cols, np.arange(len(cols[0])), np.zeros(len(cols[0]), bool), np.zeros(len(cols[0]), bool))

    def _compare(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        by, first, later = _in_order(cols)
        cols = [x[by] for x in cols]
        anchor, again = cols[0], cols[7]
        group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
        heads = np.zeros(len(by), bool)
        heads[first] = True
        strings = np.bincount(group, heads)
        asked = heads & ((strings[group] > 1) | again)
        gone = np.zeros(len(by), bool)
        gone[later] = True
        yield from _result(cols, np.flatnonzero(gone | asked), asked, asked & (strings[group] > AUTOMATON_STRINGS))

    def _result(cols: list[np.ndarray], keep: np.ndarray, asked: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchor, _, doc_id, null, h, start, n, _ = cols
        for part in np.array_split(keep, max(1, len(keep) // 100_000)):
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[part].view(np.int64)), pa.array(doc_id[part], mask=null[part]), pa.array(h[part]), pa.array(start[part]), pa.array(n[part]), pa.array(asked[part]), pa.array(wide[part])],
                    ["anchor", "doc_id", "h", "start", "n", "asked", "wide"],
                )

    found = write_table(packed.mapInArrow(compare, "anchor long, doc_id long, h long, start int, n int, asked boolean, wide boolean"), "anchored-runs")
    gone = found.filter("not asked").select("doc_id", "h", "start", "n")

    # 3. The words of the runs asked for, from their documents.
    asked = found.filter("asked").groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "start", "n", "wide")).alias("runs"))
    asked = asked.withColumnsRenamed({"doc_id": "a_doc", "h": "a_h"})
    once = narrow.join(asked, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("h") == F.col("a_h"))).select("doc_id", "h", "text", "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 18):
            ids, hs, runs_, out = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("runs"), []
            for i, text in enumerate(texts(batch)):
                words = word_hashes(text.split())
                for r in runs_[i].as_py():
                    out.append((r["anchor"], r["wide"], ids[i], hs[i], r["start"], words[r["start"] : r["start"] + r["n"] + window - 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "wide", "doc_id", "h", "start", "words"])

    strings = write_table(once.mapInArrow(fetch, "anchor long, wide boolean, doc_id long, h long, start int, words binary"), "asked-runs")

    # 4. Each anchor is a reference shard with an automaton of its own; its strings stream through it in order of documents.
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, automaton = None, None, None
        for batch in batches:
            ids, hs, starts, out = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("start").to_pylist(), []
            for i, (anchor, data) in enumerate(zip(batch.column("anchor").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                if anchor != now:
                    now, place, automaton = anchor, None, SuffixAutomaton()
                if place == (ids[i], hs[i], starts[i]):
                    continue  # a row given twice
                place = (ids[i], hs[i], starts[i])
                ends = automaton.feed(np.frombuffer(data, np.int64).tolist(), window)
                begin = 0
                for j in range(1, len(ends) + 1):
                    if j == len(ends) or ends[j] != ends[j - 1] + 1:
                        out.append((ids[i], hs[i], starts[i] + ends[begin] - window + 1, j - begin))
                        begin = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "h", "start", "n"])

    order = [F.col("anchor"), F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("start")]
    matched = strings.filter("not wide").repartition("anchor").sortWithinPartitions(*order).mapInArrow(match, "doc_id long, h long, start int, n int")

    # 5. Anchors that very many different strings share: the smallest place of each window, minima being combined before the shuffle.
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids, hs = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()], [], []
            for x in lists:
                at = np.arange(len(x) - window + 1)
                ids.append(SpanHash(x).of(at, window).view(np.int64))
                hs.append(SpanHash(x, _BASES[1]).of(at, window).view(np.int64))
            n = np.array([len(x) for x in ids], np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            if len(owner):
                start = batch.column("start").to_numpy()[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hs)), batch.column("doc_id").take(pa.array(owner)), batch.column("h").take(pa.array(owner)), pa.array(start.astype(np.int32))], ["w1", "w2", "doc_id", "h", "start"])

    each = strings.filter("wide").mapInArrow(windows, "w1 long, w2 long, doc_id long, h long, start int")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h", "start")
    least = each.groupBy("w1", "w2").agg(F.min(place).alias("least"))
    wide = each.join(least, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("least"))).select("doc_id", "h", "start", F.lit(1).alias("n"))
    return gone.unionByName(matched).unionByName(wide)


def drop_repeats(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Words are runs of anything but ASCII white space. Every word in a window of `window` consecutive words whose sequence also
    starts earlier (smaller doc_id, or same document and earlier start) is removed, judged on the input.

    Null or empty texts have no words; a null doc_id comes after all others; rows of one doc_id and text are one document given
    more than once, and each gets that document's result; rows of one doc_id with different texts come in order of their texts'
    hashes; an empty table gives no rows.
    """
    spans = repeated_spans(docs, window)
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans")).withColumnsRenamed({"doc_id": "s_doc", "h": "s_h"})
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    met = narrow.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            n_words, n_removed, shas, kept_texts = [], [], [], []
            for text, starts, ns in zip(texts(batch), batch.column("starts"), batch.column("ns"), strict=True):
                words = text.split()
                kept, removed = words, 0
                if starts.is_valid:
                    s, n = starts.values.to_numpy(), ns.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    kept, removed = list(compress(words, keep.tolist())), int((~keep).sum())
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(removed)
                shas.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined if with_text else None)
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept_texts, pa.binary()).cast(pa.string())] if with_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
