import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import simhash


def print_by_hand(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, prints, bits):
    label = list(range(len(ids)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(ids)
    for g in groups.values():
        low = min((ids[i] for i in g if ids[i] is not None), default=None)
        for i in g:
            out[i] = low
    return out


@given(st.lists(st.integers(0, 700), max_size=12))
@settings(max_examples=40, deadline=None)
def test_majority(counts):
    rng = np.random.default_rng(len(counts))
    hashes = rng.integers(0, 2**64, sum(counts), np.uint64)
    got, at = simhash.majority_bits(hashes, np.array(counts, np.int64)), 0
    for c, g in zip(counts, got.tolist(), strict=True):
        mine = hashes[at : at + c]
        assert g == sum(1 << b for b in range(64) if 2 * int(((mine >> np.uint64(b)) & np.uint64(1)).sum()) > c)
        at += c


@pytest.mark.parametrize("rows", [10, 10**5, 10**8])
@pytest.mark.parametrize("bits", [3, 4])
def test_masks_lose_no_pair(rows, bits):
    masks, rng = simhash.block_masks(bits, rows), np.random.default_rng(1)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        assert any(x & m == 0 for m in masks)


def close_prints(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, max(1, n // 20), np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(5):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
    return np.unique(out)


@pytest.mark.parametrize("node_rows", [20_000, 40, 6])
def test_links_connect_what_all_pairs_connect(spark, node_rows):
    prints = close_prints(900)
    if node_rows < 20_000:  # many that agree on most bits
        prints = np.unique(np.concatenate([prints, (prints[:400] & np.uint64(0xFFFF)) | np.uint64(7 << 60)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.hamming_links(df, 4, node_rows).collect()
    ids = prints.view(np.int64).tolist()
    want = components_by_hand(ids, prints.tolist(), 4)
    at = {x: i for i, x in enumerate(ids)}
    label = list(range(len(ids)))
    find = lambda x: x if label[x] == x else find(label[x])
    for r in links:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 64
        label[find(at[r["a"]])] = find(at[r["b"]])
    got = {}
    for i in range(len(ids)):
        got.setdefault(find(i), []).append(i)
    ours = {tuple(sorted(v)) for v in got.values()}
    theirs = {}
    for i, w in enumerate(want):
        theirs.setdefault(w, []).append(i)
    assert ours == {tuple(sorted(v)) for v in theirs.values()}


def test_documents(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(50)]
    long_ = " ".join(rng.choice(vocab, 3000))
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, "One"), (4, "one"), (5, " \n"), (6, long_), (7, long_ + " end"), (8, "no id HERE at all"), (9, "é É ünï x"), (9, "é É ünï x"), (10, "a b c d"), (11, "a b c d e")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, root int")
    got = sorted((str(r[0]), r[1], r[2]) for r in simhash.simhash_components(docs).collect())
    prints = [print_by_hand(t) for _, t in rows]
    comps = components_by_hand([r[0] for r in rows], prints, 4)
    assert got == sorted((str(r[0]), f"{p:016x}", c) for r, p, c in zip(rows, prints, comps, strict=True))


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [print_by_hand(r["text"]) for r in rows]
    want = components_by_hand([r["doc_id"] for r in rows], prints, 4)
    got = [tuple(r) for r in simhash.simhash_components(docs).orderBy("doc_id").collect()]
    assert got == [(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)]


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_dense_groups():
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(12345) ^ sum(np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64) for _ in range(2)))
    label = simhash.trie_join(fps, np.zeros(len(fps), int), np.zeros(len(fps), int), 4)
    assert (label == 0).all()


def test_near_copies(spark):
    rng = np.random.default_rng(8)
    vocab = np.array([f"w{i}" for i in range(3000)])
    rows, group = [], {}
    for i in range(60):
        words = rng.choice(vocab, 400)
        for j in range(3):
            copy = words.copy()
            copy[rng.integers(0, 400, 2 * j)] = "edited"
            rows.append((i * 10 + j, " ".join(copy), "clash"))
            group[i * 10 + j] = i
    rows += [(5000 + i, " ".join(rng.choice(vocab, 300)), "clash") for i in range(100)] + [(0, rows[0][1], "clash"), (None, rows[0][1], "clash"), (7000, None, "clash"), (7001, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(kept) == sorted([i * 10 for i in range(60)] + [5000 + i for i in range(100)] + [7000])
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def planted_pairs(changed, n, seed=4):
    """n pairs (ids 2 i and 2 i + 1) of 400 words of which one lacks `changed` of the other's 396 five-word shingles."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        words = rng.integers(0, 10**6, 400).astype(str)
        copy, at = words.copy(), rng.integers(4, 400 - changed)
        copy[at : at + changed - 4] = rng.integers(0, 10**6, changed - 4).astype(str)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return rows


@pytest.mark.parametrize("changed, least, most", [(44, 0.95, 1), (32, 0.99, 1), (20, 1, 1)])  # similarity 0.80, 0.85, 0.90
def test_near_copies_recall(spark, changed, least, most):
    docs = spark.createDataFrame(planted_pairs(changed, 300), "doc_id long, text string")
    assert least <= (600 - simhash.drop_near_copies(docs).count()) / 300 <= most


def test_near_copies_are_verified(spark):
    rng = np.random.default_rng(9)
    rows = planted_pairs(56, 60) + [(1000 + i, t) for i, t in planted_pairs(69, 60, 5)]  # similarity 0.75 and 0.70
    for i in range(60):  # different texts of which half is one line over and over
        line = " ".join(rng.integers(0, 10**6, 8).astype(str))
        rows += [(2000 + 2 * i + j, " ".join(rng.integers(0, 10**6, 200).astype(str)) + f" {line}" * 25) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == sorted(i for i, _ in rows)


@pytest.mark.parametrize("part, leaders", [(1 << 21, 16), (1500, 16), (900, 2), (1500, 1)])
def test_similar_links(spark, part, leaders, monkeypatch):
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    rng, rows = np.random.default_rng(3), [(0, ""), (1, "one"), (2, "one two")]
    words = rng.integers(0, 10**6, 80).astype(str)
    for i in range(3, 60):  # a chain with jumps
        words[rng.integers(0, 80, rng.integers(1, 5))] = str(i)
        rows.append((i, " ".join(words)))
    docs = simhash.with_row_names(spark.createDataFrame([*rows, rows[9], rows[9]], "doc_id long, text string"))
    prints = simhash.sketches(docs, 5, 42, simhash.ROW)
    got = {r["doc_id"]: r["id"] for r in prints.collect()}
    links = simhash.similar_links(docs, prints.distinct().withColumn("root", simhash.F.lit(7).cast("long")), 5, 42, 0.8).collect()
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    true = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = [(i, j) for i in range(60) for j in range(i) if true(sets[i], sets[j])]

    def groups(pairs, n=60):
        label = list(range(n))
        for i, j in pairs:
            label = [label[j] if x == label[i] else x for x in label]
        return {frozenset(k for k in range(n) if label[k] == x) for x in label}

    at = {x: i for i, x in got.items()}
    assert 3 < len(groups(want)) < 60
    assert groups([(at[r["a"]], at[r["b"]]) for r in links]) == groups(want)


def test_band_links_of_hot_buckets(spark):
    """Buckets that are cut give a superset of the links."""
    rng = np.random.default_rng(1)
    words, rows = rng.integers(0, 10**6, 100).astype(str), []
    for i in range(120):
        copy = words.copy()
        copy[rng.integers(0, 100, 2)] = str(i)
        rows.append((i, " ".join(copy)))
    nodes = simhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    for node_rows in (20_000, 10):
        links = simhash.band_links(nodes, 18, node_rows).collect()
        label = {r["id"]: r["id"] for r in nodes.collect()}
        for r in links:
            label = {k: (label[r["a"]] if v == label[r["b"]] else v) for k, v in label.items()}
        assert len(links) < 2 * 120 and len(set(label.values())) == 1


def test_one_root(spark):
    links = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (2, 6), (3, 6), (6, 7)], "a long, b long")
    assert sorted(map(tuple, simhash.one_root(links).collect())) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 6), (6, 7)]
