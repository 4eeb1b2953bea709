import hashlib
import zlib

import pytest

from corpusgraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int, idx int, members string"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def code(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row) -> str:
    return h("".join(map(code, row[:5])))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a tree and each leaf's siblings (left, right), level by level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 16 * 16 : a // 16 * 16 + 16]
            steps[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
        level = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return level[0], steps


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, top = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, top, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            folded = start
            for left, right in own + up:
                folded = h(left + folded + right)
            out.append((r[0], leaf, trees[s][0], root, h("".join(a + b for a, b in own + up)), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2, "m") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df).drop("proof").collect()), key=repr)


def docs(n, source, start=0):
    return [(start + i, source, "en" if i % 3 else None, i, f"Text {i} Ä\n" * (i % 4)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 5}, {"a": 17}, {"a": 1, "b": 1}, {"a": 300, "B": 16, "": 1, None: 33, "ä": 256, "z": 257}])
def test_trees(spark, sizes):
    rows, start = [], 0
    for source, n in sizes.items():
        rows += docs(n, source, start)
        start += n
    assert got(spark, rows) == by_hand(rows)


def test_many_sources(spark):
    rows = [x for i in range(300) for x in docs(1 + i % 2, f"s{i}", 10 * i)]
    assert got(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    """Nulls in all columns, repeated rows, ids given twice with different texts, a long text, a hot group of equal rows."""
    same = (7, "a", "en", 3, "ABC")
    rows = [same] * 40 + [(None, None, None, None, None)] * 3 + [(7, "a", "en", 3, "abc"), (None, "a", "de", 1, "X"), (8, "a", None, None, ""), (9, "a", "en", 1 << 40, "Ab" * 500_000)]
    assert got(spark, rows) == by_hand(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_proof_of_each_leaf(spark):
    """The proof itself folds to the root; only tampered texts with capitals fail."""
    rows = docs(100, "a")
    for r in merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect():
        d = r["leaf"]
        for s in r["proof"]:
            d = h(s["left"] + d + s["right"])
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] % 4 > 0
        assert d == r["root"] and r["verified"] == (not changed)
