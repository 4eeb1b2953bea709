"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join under a Hamming budget."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, text_slices, texts, with_row_names, write_table
from .components import connected_components

#: Comparisons that cost as much as bringing one row to its bucket, as measured (about 3 microseconds a row, 80 nanoseconds a pair).
ROW_COST = 40
#: Rows of a bucket that go to one task at most; larger ones are cut into pairs of trie nodes.
NODE_ROWS = 20_000
#: Rows that a task joins at a time.
JOIN_ROWS = 100_000
#: Fingerprint pairs compared in one step.
PAIR_STEP = 1 << 20
#: Shingles of a candidate group that one task compares exactly; larger groups are compared with leaders first.
PART_SHINGLES = 1 << 21
#: Leaders of a larger group: what is similar to them, directly or by way of other leaders, need not be compared with each other.
LEADERS = 16
#: Bits of the table that says which texts may be candidates.
FILTER_BITS = 1 << 26
#: Bands of the sketch by which near copies meet, and minima of a band: at similarity 0.8, 0.996 of pairs share a band.
BANDS, BAND_ROWS = 14, 5


def shingle_hashes(text: bytes, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each n-word shingle (the whole sequence if it is shorter, none without words) of A-Z lower-cased UTF-8 text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate([[0], ends[: len(words) - n]]).tolist()
    last = (ends[n - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of `counts` hashes, the bits set in over half of a group; 0 for an empty group."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    full = counts[some].astype(np.int64)
    # pieces of 255 hashes at most, so that 8 counters fit a 64-bit word
    pieces = -(-full // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(full) - full, pieces) + 255 * nth
    tops = np.cumsum(pieces) - pieces
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        per = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), tops, axis=0)
        for lane in range(8):
            out[some] |= (2 * per[:, lane] > full).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 4, seed: int = 42, keep: tuple = ()) -> DataFrame:
    """doc_id, fp (and the columns in keep) of each document; a text without words, or null, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            hashes = [shingle_hashes(t, shingle_words, seed) for t in texts(batch)]
            prints = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + [pa.array(prints.view(np.int64))], ["doc_id", *keep, "fp"])

    return _mapped(docs, run, keep, ("fp",))


def _mapped(docs: DataFrame, run, keep: tuple, names: tuple) -> DataFrame:
    narrow = docs.select("doc_id", *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(run, f"{schema}, " + ", ".join(f"{x} long" for x in names))


def band_keys(hashes: np.ndarray, counts: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """(bands, groups): for consecutive groups of `counts` distinct hashes, a key of each band of `rows` minima over permuted hashes.

    Two sets of Jaccard similarity s share a band with probability 1 - (1 - s**rows)**bands, however many sets there are; keys of
    different bands differ. Empty groups share all keys.
    """
    odd = np.random.default_rng(64).integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    out = np.zeros((bands, len(counts)), np.uint64)
    for band in range(bands):
        key = np.full(len(some), band + 1, np.uint64)
        for x in odd[band]:
            key = _mixed(key ^ np.minimum.reduceat(hashes * x, starts)) if len(some) else key
        out[band, some] = key
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sketches(docs: DataFrame, shingle_words: int, seed: int = 42, keep: tuple = ()) -> DataFrame:
    """doc_id and the columns in keep with id (a name of the set of distinct shingles), n (its size), fp (its fingerprint) and band keys b0, b1, ..."""
    names = ("id", "n", "fp", *(f"b{k}" for k in range(BANDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle_words, seed)) for t in texts(batch)]
            flat, counts = np.concatenate(sets), np.array([len(h) for h in sets])
            named = np.array([xxhash.xxh64_intdigest(h.tobytes(), 0) for h in sets], np.uint64)
            made = [named, counts.astype(np.uint64), majority_bits(flat, counts), *band_keys(flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + [pa.array(x.view(np.int64)) for x in made], ["doc_id", *keep, *names])

    return _mapped(docs, run, keep, names)


def block_masks(max_bits: int, rows: int) -> list[int]:
    """Bit masks of which two fingerprints within max_bits must agree on at least one (pigeonhole over equal blocks).

    More blocks mean longer masks, so smaller buckets, but more of them: of all numbers of blocks the one with the least work, a row
    in a bucket costing about as much as ROW_COST comparisons.
    """

    def work(blocks: int) -> float:
        exact = blocks - max_bits
        return math.comb(blocks, exact) * (ROW_COST + rows / 2 ** (64 * exact / blocks) / 2)

    blocks = min(range(max_bits + 1, min(64, max_bits + 8)), key=work)
    exact = blocks - max_bits
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << j for j in range(a, b)) for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(parts, exact)]


class _Forest:
    """Components of row numbers by minimum labels, all links of a step at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def trie_join(fps: np.ndarray, groups: np.ndarray, sides: np.ndarray, max_bits: int) -> np.ndarray:
    """Component label (the smallest row number) of each row, linking rows of one group within max_bits.

    Rows are sorted by group, side, fingerprint. A group of side 0 alone is joined with itself, one of both sides side by side.
    Pairs of nodes of the binary trie go down together, a bit at a time; a pair whose bits differ adds one to its count and is
    dropped beyond max_bits; small pairs are compared row by row. A node's own pairs come before those of two nodes, and a pair
    whose rows are all in one component already is dropped, so that a dense group takes few comparisons.
    """
    forest = _Forest(len(fps))
    runs = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])]))
    stops = np.concatenate([runs[1:], [len(fps)]])
    two = np.concatenate([groups[runs][1:] == groups[runs][:-1], [False]])  # this run is side 0 of a group of both sides
    second = np.concatenate([[False], two[:-1]])
    a = np.flatnonzero(~second)
    b = np.where(two[a], a + 1, a)
    # a group of both sides may lack rows on side 0 or 1: then its one run has nothing to join with
    alone = (a == b) & (sides[runs[a]] == 1)
    a, b = a[~alone], b[~alone]
    todo = [(63, np.stack([runs[a], stops[a], runs[b], stops[b], np.zeros(len(a), np.int64)]))]
    zeros: dict[int, np.ndarray] = {}

    def compare(pairs: np.ndarray) -> None:
        wide = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        cuts = np.searchsorted(np.cumsum(wide), np.arange(PAIR_STEP, wide.sum() + PAIR_STEP, PAIR_STEP))
        for part in np.split(np.arange(len(wide)), cuts):
            if len(part):
                p, w = pairs[:, part], wide[part]
                at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                nb = np.repeat(p[3] - p[2], w)
                i, j = np.repeat(p[0], w) + at // nb, np.repeat(p[2], w) + at % nb
                near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= max_bits)
                forest.link(i[near], j[near])

    while todo:
        bit, pairs = todo.pop()
        label = np.concatenate([forest.label, [0]])  # reduceat takes ranges that end at the last row
        low, high = (np.stack([f.reduceat(label, np.stack([pairs[k], pairs[k + 1]], axis=1).ravel())[::2] for k in (0, 2)]) for f in (np.minimum, np.maximum))
        pairs = pairs[:, (low.min(axis=0) != high.max(axis=0)) | (bit == 63)]
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 64
        compare(pairs[:, small])
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if bit < 0:  # equal fingerprints
            near = pairs[4] <= max_bits
            compare(pairs[:, near])
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)])
        z = zeros[bit]
        al, ah, bl, bh, d = pairs
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        own = (al == bl) & (ah == bh)
        one = np.concatenate([np.stack([al, am, bl, bm, d]), np.stack([am, ah, bm, bh, d])], axis=1)
        two = np.concatenate([np.stack([al, am, bm, bh, d + 1]), np.stack([am, ah, bl, bm, d + 1])[:, ~own]], axis=1)
        twice = np.concatenate([own, own])
        for below in (np.concatenate([two, one[:, ~twice]], axis=1), one[:, twice]):
            below = below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= max_bits)]
            todo += [(bit - 1, below[:, k : k + PAIR_STEP // 8]) for k in range(0, below.shape[1], PAIR_STEP // 8)]
    return forest.label


def hamming_links(fps: DataFrame, max_bits: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Of distinct fingerprints (fp), links (a, b) that connect the same components as all pairs within max_bits.

    Every mask of block_masks deals the fingerprints into buckets; a bucket is the root of a trie whose node pairs go down together
    in one task. A bucket over about node_rows is cut at a depth of 12 more bits: pairs of its nodes within the budget become groups of
    their own, and a node that still is too large is cut by hash.
    """
    masks = block_masks(max_bits, fps.count())
    signed = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = fps.select("fp", F.posexplode(signed).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    hot = _hot(rows, ["t", "key"], "fp", node_rows)
    some_hot = bool(hot.head(1))
    cool = rows.join(hot, ["t", "key"], "left_anti") if some_hot else rows
    # groups go by a hash of their name alone: two of one hash are compared with each other to no effect
    groups = cool.select(F.xxhash64("t", "key").alias("g"), F.lit(0).cast("byte").alias("side"), "fp", F.col("fp").alias("id"))
    if some_hot:
        # the node: 12 bits outside the mask, gathered from the lowest ones
        node = F.lit(0)
        for t, mask in enumerate(masks):
            gathered = F.lit(0)
            for k, j in enumerate([j for j in range(64) if not mask >> j & 1][:12]):
                gathered = gathered.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", j).bitwiseAND(F.lit(1)).cast("int"), k))
            node = F.when(F.col("t") == t, gathered).otherwise(node)
        big = rows.join(hot, ["t", "key"], "left_semi").withColumn("node", node)
        nodes = big.groupBy("t", "key", "node").count().withColumn("subs", F.ceil(F.col("count") / (node_rows // 2)).cast("int"))
        parts = nodes.select("t", "key", "node", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
        other = parts.select("t", "key", F.col("node").alias("y"), F.col("sub").alias("sy"))
        pairs = parts.select("t", "key", F.col("node").alias("x"), F.col("sub").alias("sx")).join(other, ["t", "key"])
        pairs = pairs.filter("struct(x, sx) <= struct(y, sy)").filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
        pairs = write_table(pairs, "trie-node-pairs")
        big = big.join(nodes.drop("count"), ["t", "key", "node"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int")).drop("subs")
        big = write_table(big, "trie-hot-rows")
        left = big.withColumnsRenamed({"node": "x", "sub": "sx"}).join(pairs, ["t", "key", "x", "sx"]).withColumn("side", F.lit(0).cast("byte"))
        right = big.withColumnsRenamed({"node": "y", "sub": "sy"}).join(pairs.filter("not (x = y and sx = sy)"), ["t", "key", "y", "sy"]).withColumn("side", F.lit(1).cast("byte"))
        cut = left.unionByName(right).withColumn("g", F.xxhash64("t", "key", "x", "y", "sx", "sy")).withColumn("id", F.col("fp"))
        groups = groups.unionByName(cut.select(groups.columns))
    return one_root(trie_links(groups, max_bits))


def _hot(rows: DataFrame, bucket: list[str], name: str, node_rows: int) -> DataFrame:
    """Buckets over about node_rows, found by a sample: how a bucket is joined changes no result, so they need not be exact."""
    share = min(1.0, 1000 / node_rows)  # of node_rows rows about a thousand are in the sample, and half of that makes a bucket hot
    sample = rows.filter(F.pmod(F.xxhash64(name), F.lit(1000)) < 1000 * share)
    return write_table(sample.groupBy(*bucket).count().filter(F.col("count") > share * node_rows / (1 if share == 1 else 2)).select(*bucket), "trie-hot-buckets")


def trie_links(groups: DataFrame, max_bits: int) -> DataFrame:
    """Of groups (g, side, fp, id), links (a, b) of a spanning forest of each group's pairs within max_bits, from the smallest id of a tree."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            group, side, fp, name = (table.column(c).to_numpy() for c in ("g", "side", "fp", "id"))
            by = np.lexsort((fp.view(np.uint64), side, group))
            group, side, fp, name = group[by], side[by], fp[by], name[by]
            label = trie_join(fp.view(np.uint64), group, side, max_bits)
            least = name.copy()
            np.minimum.at(least, label, name)
            tied = np.flatnonzero(least[label] != name)
            return pa.RecordBatch.from_arrays([pa.array(least[label[tied]]), pa.array(name[tied])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= JOIN_ROWS:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                cut = table.num_rows - int((g == g[-1]).sum())  # the last group may go on
                if cut:
                    yield links(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield links(pa.Table.from_batches(held))

    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(join, "a long, b long").distinct()


def one_root(links: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of the same components with one link of each b: to its least a, and from its other a to that one.

    A node of one dense group has another a in each of its buckets; these links bring them together by aggregation, without a join.
    The set of one b is as large as the number of its buckets at most.
    """
    seen = links.groupBy("b").agg(F.collect_set("a").alias("roots")).select("b", "roots", F.array_min("roots").alias("m"))
    ends = F.concat(F.array("b"), F.filter("roots", lambda x: x != F.col("m")))
    return seen.select("m", F.explode(ends).alias("b")).select(F.col("m").alias("a"), "b").distinct()


def band_links(nodes: DataFrame, max_bits: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Of sets (id, fp, b0, b1, ...), links (a, b) that connect what shares a band and differs in max_bits bits at most.

    A band's bucket is the root of a trie; a row is copied once for each band, at any size of the corpus. Sets of one bucket over
    about node_rows, which agree on a whole band, are all linked to their smallest id instead: a superset of its links, in one row each.
    """
    rows = nodes.select("id", "fp", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("g"))
    hot = _hot(rows, ["g"], "id", node_rows)
    if not hot.head(1):
        return one_root(trie_links(rows.withColumn("side", F.lit(0).cast("byte")), max_bits))
    cool = rows.join(hot, "g", "left_anti").withColumn("side", F.lit(0).cast("byte"))
    big = rows.join(hot, "g", "left_semi")
    stars = big.join(big.groupBy("g").agg(F.min("id").alias("a")), "g").filter("a <> id").select("a", F.col("id").alias("b"))
    return one_root(trie_links(cool, max_bits).unionByName(stars))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash_components(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Equal fingerprints are one node, so copies cost one row. Null or wordless texts have fingerprint zero and are linked like any
    other; repeated rows each get a row; a null doc_id belongs to the component of its fingerprint, whose id is the smallest doc_id
    that is not null (null if there is none); an empty table gives no rows.
    """
    prints = write_table(fingerprints(docs, shingle_words, seed), "fingerprints")
    nodes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = connected_components(hamming_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(rooted, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_sets(sets: list[np.ndarray], least: float, joined: np.ndarray | None = None) -> np.ndarray:
    """Component label of each set (of distinct values), linking sets of Jaccard similarity `least` and more, all pairs considered.

    Sets marked in joined are of one component to begin with.
    """
    sizes = np.array([len(x) for x in sets])
    by = np.argsort(sizes, kind="stable")
    sizes, ends = sizes[by], np.concatenate([[0], np.cumsum(sizes[by])])
    values, flat = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True)
    label, mark = np.arange(len(sets)), np.zeros(len(values), bool)
    if joined is not None and joined.any():
        label[joined[by]] = np.flatnonzero(joined[by])[0]
    # a set is compared with the larger ones that are not too large and not of its component yet
    stops = np.searchsorted(sizes * least, sizes + 1e-9, "right")
    for i, stop in enumerate(stops.tolist()):
        others = np.flatnonzero(label[i + 1 : stop] != label[i]) + i + 1
        if not sizes[i] or not len(others):
            continue
        n = sizes[others]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(ends[others] - starts, n)
        mine = flat[ends[i] : ends[i + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[flat[at]], starts, dtype=np.int64)
        mark[mine] = False
        near = shared >= least * (sizes[i] + n - shared) - 1e-9
        if near.any():
            tied = np.unique(np.append(label[others[near]], label[i]))
            label[np.isin(label, tied)] = tied[0]
    out = np.empty(len(sets), np.int64)
    out[by] = label
    return out


def similar_links(docs: DataFrame, members: DataFrame, shingle_words: int, seed: int, least: float) -> DataFrame:
    """Links (a, b) of sets of one candidate group (members: row names, id, root, n) whose exact similarity is at least `least`.

    They connect what all pairs of that similarity within the group connect. A group up to PART_SHINGLES is compared in one task. Of
    a larger one each set is compared with LEADERS of its sets, in parts; those that are similar to the leaders of the largest
    component are of one component, and only the rest is compared with all sets, each part of it with each part of them.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a row that is given many times
        for batch in batches:
            for piece in text_slices([batch], "text"):
                new = [i for i, x in enumerate(piece.column("id").to_pylist()) if not (x in seen or seen.add(x))]
                piece = piece.take(pa.array(new, pa.int64()))
                sets = [np.unique(shingle_hashes(t, shingle_words, seed)).tobytes() for t in texts(piece)]
                yield pa.RecordBatch.from_arrays([piece.column("root"), piece.column("id"), pa.array(sets, pa.binary())], ["root", "id", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(sets: dict[int, tuple]) -> pa.RecordBatch:
            names, core = np.array(list(sets), np.int64), np.array([x[1] for x in sets.values()])
            label = similar_sets([x[0] for x in sets.values()], least, core)
            first = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(first, label, names)
            tied = first[label] != names
            return pa.RecordBatch.from_arrays([pa.array(first[label][tied]), pa.array(names[tied])], ["a", "b"])

        group, sets = None, {}
        for batch in batches:
            for g, name, core, shingles in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "core")), batch.column("shingles"), strict=True):
                if g != group:
                    if len(sets) > 1:
                        yield links(sets)
                    group, sets = g, {}
                sets[name] = np.frombuffer(shingles.as_py(), np.uint64), core
        if len(sets) > 1:
            yield links(sets)

    given = _perhaps(docs.select(*ROW, "text"), members).join(members.select(*ROW, "id", "root"), list(ROW))
    sets = write_table(given.select("root", "id", "text").mapInArrow(shingled, "root long, id long, shingles binary"), "copy-sets")
    large = members.groupBy("root").agg(F.ceil(2 * F.sum("n") / PART_SHINGLES).cast("int").alias("parts")).filter("parts > 2")
    large = write_table(large, "copy-parts")
    tasks = sets.withColumn("g", F.xxhash64("root")).withColumn("core", F.lit(False))
    extra = None
    if large.head(1):
        tasks = tasks.join(large, "root", "left_anti")
        big = sets.join(large, "root").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        met = write_table(_meet_leaders(big, least), "copy-leaders")
        extra, core = _leader_links(met)
        open_ = met.select("root", "id", "mask").distinct().join(core, "root").withColumn("core", F.col("mask").bitwiseAND(F.col("cores")) != 0).select("root", "id", "core")
        marked = write_table(big.join(open_, ["root", "id"]), "copy-open")
        rest = marked.filter("not core").groupBy("root").agg(F.ceil(F.sum(F.length("shingles")) / (4 * PART_SHINGLES)).cast("int").alias("rests"))
        marked = marked.join(rest, "root")
        all_ = marked.withColumn("x", F.sequence(F.lit(0), F.col("rests") - 1)).withColumn("gs", F.transform("x", lambda i: F.xxhash64("root", i, "part")))
        mine = F.pmod(F.xxhash64("id", F.lit(1)), F.col("rests")).cast("int")
        ours = marked.filter("not core").withColumn("x", F.sequence(F.lit(0), F.col("parts") - 1)).withColumn("gs", F.transform("x", lambda j: F.xxhash64("root", mine, j)))
        more = all_.unionByName(ours).select(F.explode("gs").alias("g"), "id", "core", "shingles")
        tasks = tasks.select(more.columns).unionByName(more)
    links = tasks.select("g", "id", "core", "shingles").repartition("g").sortWithinPartitions("g").mapInArrow(verified, "a long, b long")
    return (links if extra is None else links.unionByName(extra)).distinct()


def _perhaps(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of docs that members may name, by a bit table of 8 to 16 bits a name (FILTER_BITS at most), so that few other texts are shuffled for the join."""
    bits = min(FILTER_BITS, max(64, 1 << (8 * members.count()).bit_length()))
    place = F.pmod(ROW[0], F.lit(bits))
    words = members.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("_bits"))
    met = docs.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word")  # a row for each 64 bits, so 2 ** 20 rows at most
    return met.filter(F.expr(f"getbit(_bits, cast(pmod({ROW[0]}, 64L) as int)) = 1")).drop("_word", "_bits")


def _meet_leaders(big: DataFrame, least: float) -> DataFrame:
    """Of sets (root, id, shingles, part, parts): root, id, mask (bit i: similar to leader i), first (the first such leader), bit (a leader's own)."""
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("id", F.lit(5)), "id"))
    leaders = big.select("root", "id").distinct().withColumn("nth", place - 1).filter(F.col("nth") < LEADERS)
    led = big.join(leaders, ["root", "id"]).dropDuplicates(["root", "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = led.select("root", "part", "id", "nth", "shingles").unionByName(big.select("root", "part", "id", F.lit(LEADERS).alias("nth"), "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ahead = None, []
        for batch in batches:
            out = []
            for root, part, name, nth, shingles in zip(*(batch.column(c).to_pylist() for c in ("root", "part", "id", "nth")), batch.column("shingles"), strict=True):
                mine = np.frombuffer(shingles.as_py(), np.uint64)
                if (root, part) != of:
                    of, ahead = (root, part), []
                if nth < LEADERS:
                    ahead.append((name, mine))
                    continue
                mask, first, bit = 0, None, None
                for i, (leader, theirs) in enumerate(ahead):
                    bit = 1 << i if leader == name else bit
                    if min(len(mine), len(theirs)) >= least * max(len(mine), len(theirs)) - 1e-9:
                        shared = np.count_nonzero(theirs[np.searchsorted(theirs, mine).clip(max=len(theirs) - 1)] == mine) if len(theirs) else 0
                        if shared >= least * (len(mine) + len(theirs) - shared) - 1e-9:
                            mask |= 1 << i
                            first = leader if first is None else first
                out.append((root, name, mask, first, bit))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["root", "id", "mask", "first", "bit"])

    return both.repartition("root", "part").sortWithinPartitions("root", "part", "nth").mapInArrow(run, "root long, id long, mask long, first long, bit long")


def _leader_links(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of sets with the first leader they are similar to and of leaders that one set is similar to; root, cores: the leaders of its largest component."""
    one = met.filter("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b"))
    # a group has 2 ** LEADERS masks at most
    kinds = write_table(met.filter("mask <> 0").groupBy("root", "mask").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "copy-masks")
    tied = kinds.join(met.filter("bit is not null").select("root", F.col("id").alias("leader"), "bit").distinct(), "root")
    two = tied.filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).filter("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))

    def largest(kinds):
        import pandas as pd

        groups: list[list[int]] = []  # mask of leaders, rows
        for mask, n in zip(kinds["mask"].tolist(), kinds["n"].tolist(), strict=True):
            apart = [g for g in groups if not g[0] & mask]
            for g in groups:
                if g[0] & mask:
                    mask, n = mask | g[0], n + g[1]
            groups = [*apart, [mask, n]]
        return pd.DataFrame({"root": kinds["root"].iloc[:1], "cores": [max(groups, key=lambda g: (g[1], -g[0]))[0]]})

    some = kinds.groupBy("root").applyInPandas(largest, "root long, cores long")
    return one.unionByName(two), some


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, max_bits: int = 18, seed: int = 42, least: float = 0.8) -> DataFrame:
    """The documents (all their columns) but for one of each group of near copies: the one with the smallest doc_id stays.

    Documents are linked if their sets of distinct five-word shingles have a Jaccard similarity of `least` or more, and groups are
    components of links. Candidates are pairs that share one of BANDS bands of BAND_ROWS minima (996 of 1,000 pairs at similarity
    0.8) and whose fingerprints differ in max_bits bits at most (at 0.8 they differ in 9.7 bits on average, and 999 of 1,000 pairs
    in 18 at most). Components of candidates are then compared exactly, so no document goes by its sketch alone.

    Null or wordless texts are copies of each other; of repeated rows of the smallest doc_id the one first by the hash of all
    columns stays; null doc_id counts as largest; an empty table gives no rows.
    """
    marked = with_row_names(docs)
    prints = write_table(sketches(marked, shingle_words, seed, ROW), "copy-sketches")
    names = ["n", "fp", *(f"b{k}" for k in range(BANDS))]
    nodes = prints.groupBy("id").agg(F.min(F.struct(*ROW)).alias("row"), *[F.min(x).alias(x) for x in names])
    nodes = write_table(nodes.select("id", "row.*", *names), "copy-nodes")
    near = connected_components(band_links(nodes, max_bits))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    members = write_table(nodes.select("id", *ROW, "n").join(near, "id"), "copy-candidates")
    roots = connected_components(similar_links(marked, members, shingle_words, seed, least))
    rooted = prints.select("id", "doc_id", *ROW).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *ROW)
    kept = rooted.groupBy("root").agg(F.min(first).alias("first")).select("first.*").select(*ROW)
    return numbered(marked).filter("_i = 1").join(kept, list(ROW), "left_semi").select(docs.columns)
