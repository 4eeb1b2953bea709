"""Registered queries against their SQL on small tables of odd rows."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusgraph.operators.passages import Blocks
from corpusgraph.plans import registered
from tests.test_ingest import locate_by_hand
from tests.test_queries import rows

QUERIES, ORACLES = registered()


@pytest.fixture
def same(spark, tmp_path):
    """A function that holds a query against its SQL over tables given as columns."""

    def check(name, **tables):
        c = duckdb.connect()
        for t, columns in tables.items():
            pq.write_table(pa.table(columns), path := str(tmp_path / f"{t}.parquet"))
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
        df, want = QUERIES[name](spark, str(tmp_path)), c.execute(ORACLES[name])
        got = rows(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])
        assert len(got) > 0 and got == rows([x[0] for x in want.description], want.fetchall())
        return got

    return check


def test_mentions_round_as_sql(same):
    """A customer an order: scores between two cents, such as 0.565, and orders without a number."""
    cents = [*range(0, 10_000, 50), *range(5, 100, 10)]
    n = len(cents)
    keys = [*range(n), None]
    orders = {"o_orderkey": keys, "o_custkey": [*range(n), 0], "o_orderstatus": ["O"] * (n + 1), "o_totalprice": [x / 100 for x in cents] + [cents[0] / 100], "o_orderdate": [dt.datetime(2000, 1, 1)] * (n + 1), "o_orderpriority": [""] * (n + 1)}
    orders = {k: v * 2 for k, v in orders.items()} | {"o_totalprice": orders["o_totalprice"] + [300_000 + x for x in orders["o_totalprice"]]}
    customer = {"c_custkey": [*range(n)], "c_name": [f"Customer#{i}" for i in range(n)], "c_nationkey": pa.array([0] * n, pa.int32()), "c_acctbal": [0.0] * n, "c_mktsegment": ["A"] * n}
    orders["o_orderkey"] = [None if k is None else k + n * (i > n) for i, k in enumerate(orders["o_orderkey"])]
    same("g1_merge_mentions", orders={k: pa.array(v, pa.int64()) if k.endswith("key") else v for k, v in orders.items()}, customer=customer)


def docs(texts):
    n = len(texts)
    return {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}


def test_markers_in_odd_texts(same):
    texts = ["", None, " lead", "\n\nx\n", "\t<unused7>: own", "a <unused3> b", "<", "<_<unused1>:", "x<_unused2>", "\x0b y", "end <unused", " z ", "<unused1>: "]
    assert len(same("s_markers", documents=docs(texts))) == len(texts)


def test_near_pairs_of_odd_texts(same):
    """Near copies in groups and chains within documents, similarities between two millionths such as 549/640, exact copies, short, empty and null texts."""
    rng, texts = random.Random(7), ["", None, "short", "\n\n"]
    base = "".join(rng.sample([chr(0x4E00 + i) for i in range(2000)], 644))  # 640 shingles
    texts.append("\n".join([base, base[:553], base[:614], base[:60], base.upper(), base[:600] + " again"]))
    for _ in range(12):
        lines = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(25)) for _ in range(3)]
        for _ in range(rng.randrange(12)):
            words = rng.choice(lines).split()
            words[rng.randrange(25)] = "".join(rng.choices("xyz", k=4))
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    assert len(same("d5_near_pairs", documents=docs(texts))) > 50


@pytest.mark.parametrize("name", ["j9_locate_passage", "j9_accent_free"])
def test_passages_of_odd_texts(same, name):
    """Lines within earlier and later lines, at the edges of words and without long words; repeated, wordless, empty and null ones; a text of many lines."""
    rng = random.Random(3)
    texts = ["", None, "\n", "ab\nx abc y\nb\n!!\nbc\nab", "Résumé d'été\nle resume d ete\nE", "same\nsame\nsame", "Straße\nSTRASSE", "über alles\nBER ALL\n12 3\n2"]
    texts.append("\n".join(" ".join(rng.choices(["tion", "station", "nations", "rat", "rational", "a", "be"], k=rng.randrange(1, 6))) for _ in range(300)))
    assert len(same(name, documents=docs(texts))) > 300


def test_blocks_by_words_as_by_the_whole_text():
    """Both ways give what all blocks by hand give, for needles whole in a block, scattered over it, and of short words."""
    rng = random.Random(5)
    words = ["tion", "station", "nations", "rationale", "rational", "ab", "c", "resume", "sumer", "presumed"]
    for _ in range(60):
        blocks = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in rng.sample(range(100), 12)]
        needles = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(12)] + ["esum", "c", "b c", "none of these words"]
        whole, by_words = Blocks(blocks, needles), Blocks(blocks, needles, direct=0)
        assert whole.direct and not by_words.direct
        for n in needles:
            assert whole.find(n) == by_words.find(n) == locate_by_hand(n, blocks)


@pytest.mark.parametrize("name, text", [("j9_locate_passage", "a line of words"), ("j9_accent_free", "a line of words"), ("d5_near_pairs", "a line of words " * 5)])
def test_only_documents_are_shuffled(spark, tmp_path, name, text):
    """No grams and no shingles are rows of their own: what is sent grows with the texts, not many times as fast."""
    lines = ["".join(random.Random(i).choices("abcdefgh ", k=400)) for i in range(200)]
    pq.write_table(pa.table(docs(["\n".join(lines), text])), str(tmp_path / "documents.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == plan.count("Generate posexplode") > 0
