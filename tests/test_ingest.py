"""Ingest, replacement by batches, streams that close, pages, the corpus graph, names in texts."""

import datetime as dt
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import chat as C
from corpusgraph.operators import chunking as K
from corpusgraph.operators import documents as D
from corpusgraph.operators import graph as G
from corpusgraph.operators import names as N
from corpusgraph.plans import ingest_queries as Q
from corpusgraph.plans import registered
from corpusgraph.sources import batches
from corpusgraph.streaming import events as E

QUERIES = registered()[0]


# --- ingest -------------------------------------------------------------------------------------------------------------------------


def chunk_rows(df):
    return sorted((r["document_id"], r["chunk_index"], r["page_no"], r["content"], tuple(round(x, 9) for x in r["embedding"])) for r in df.collect())


def test_ingest_equals_its_batch_twin(spark, sf_dir):
    """The stream's table is what one batch over all documents gives, and a batch that runs again changes nothing."""
    docs = Q.ingested(spark, sf_dir)
    want = chunk_rows(E.prepare_documents(docs))
    assert len(want) > 300 and chunk_rows(QUERIES["st5_ingest_chunks"](spark, sf_dir)) == want
    path = E.scratch(spark, "twin")
    parts = [docs.filter("document_id % 2 = 0"), docs.filter("document_id % 2 = 1")]
    for number in (0, 1, 0, 1):  # both batches are replayed
        rows = E.prepare_documents(parts[number])
        E.replace_documents(spark, rows, path, number, parts[number].select("document_id"))
    assert chunk_rows(E.read_documents(spark, path)) == want


def test_ingest_replaces_documents(spark):
    """A document that comes again has its new chunks alone; of one given twice in a batch the later counts; one of noise alone has none."""
    long = "This sentence is long enough to be kept as a chunk of its own, whatever comes. "
    text = lambda x: f"# {x}\n" + f"{x} says this. " + long
    rows = [(1, 0, text("alpha")), (2, 0, text("beta")), (3, 0, "x"), (4, 0, None), (1, 1, text("old")), (1, 2, text("gamma")), (2, 3, "tiny")]
    stream = spark.createDataFrame(rows, "document_id long, seq long, text string")
    path, state = E.scratch(spark, "table"), E.scratch(spark, "state")
    source = E.scratch(spark, "source")
    for part in ("seq = 0", "seq > 0"):
        stream.filter(part).coalesce(1).write.mode("append").parquet(source)
        E.ingest_stream(spark.readStream.schema(stream.schema).parquet(source), path, state, order="seq").awaitTermination()
    got = {r["document_id"]: r for r in E.read_documents(spark, path).collect()}
    assert set(got) == {1} and got[1]["content"].startswith("gamma") and got[1]["heading_path"] == ["gamma"] and len(got[1]["embedding"]) == 64
    assert {r["document_id"]: r["n_chunks"] for r in batches.key_rows(spark, path, E.DOCUMENT).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_batches(spark, tmp_path):
    """Later numbers win whatever the order of writing, a batch run again overwrites itself alone, null keys are keys, columns may be added."""
    path = str(tmp_path / "t")
    put = lambda rows, n, keys=None: batches.put_batch(spark.createDataFrame(rows, "k long, v string"), path, ["k"], n, keys)
    read = lambda p=path: sorted((tuple(r) for r in batches.read_batches(spark, p, ["k"]).select("k", "v").collect()), key=repr)
    assert batches.read_batches(spark, path, ["k"]) is None
    put([(1, "a"), (1, "b"), (2, "c"), (None, "n")], 5)
    put([(1, "late")], 3)
    assert read() == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "n")], key=repr)
    for _ in range(2):
        put([(2, "d"), (None, "m")], 6, spark.createDataFrame([(2,), (1,), (None,)], "k long"))
    assert read() == sorted([(2, "d"), (None, "m")], key=repr)
    other = str(tmp_path / "u")
    batches.compact(spark, path, other, ["k"])
    assert read(other) == read()
    batches.put_batch(spark.createDataFrame([(9, "x", 1)], "k long, v string, w int"), path, ["k"], 7)
    assert {r["k"]: r["w"] for r in batches.read_batches(spark, path, ["k"]).collect()} == {2: None, None: None, 9: 1}


def test_a_batch_writes_only_itself(spark, tmp_path):
    path = tmp_path / "t"
    frame = lambda rows: spark.createDataFrame(rows, "document_id long, content string")
    E.replace_documents(spark, frame([(i, "x" * 100) for i in range(5000)]), str(path), 1)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    E.replace_documents(spark, frame([(7, "y")]), str(path), 2)
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert before.items() <= after.items() and sum(p.stat().st_size for p in set(after) - set(before)) < 20_000
    assert E.read_documents(spark, str(path)).filter("document_id = 7").select("content").first()[0] == "y"


# --- streams that close ---------------------------------------------------------------------------------------------------------------


def test_state_ends_with_the_answers(spark, sf_dir):
    """After the last event no session has state; stream and batch give the same answers."""
    stream = E.closed_answers_stream(E.replay_in_order(Q.ticked(spark, sf_dir), "ts"), "12 hours")
    got, kept = E.run_appended(spark, stream)
    assert kept[-1] == 0 and max(kept) > 0
    want = E.closed_answers(Q.ticked(spark, sf_dir), "12 hours")
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 20 and rows == sorted(map(tuple, want.collect()))


def test_answers_out_of_order(spark):
    """Events in any order within the delay, several answers a session, rollbacks, silence, null data, a session that stays open."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [
        ("a", 3, at(3), "complete", None), ("a", 1, at(1), "token", "x"), ("a", 2, at(2), "token", "y"), ("a", 5, at(5), "token_rollback", None), ("a", 4, at(4), "token", "lost"), ("a", 6, at(6), "token", "z"),
        ("b", 1, at(0), "token", None), ("b", 2, at(1), "token", "q"), ("b", 9, at(50), "token", "again"), ("b", 10, at(51), "complete", None), ("c", 1, at(2), "status", "s"), ("d", 1, at(200), "token", "open"), ("", 0, at(210), E.TICK, None),
    ]
    df = spark.createDataFrame(rows, "session string, seq long, ts timestamp, event string, data string")
    path = E.scratch(spark, "odd")
    for part in (rows[:6], rows[6:11], rows[11:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, kept = E.run_appended(spark, E.closed_answers_stream(stream, "30 minutes", "60 minutes"))
    assert kept[-1] == 1  # d
    want = {("a", 1, 3, "xy", True), ("a", 4, 6, "z", False), ("b", 1, 2, "q", False), ("b", 9, 10, "again", True), ("c", 1, 1, "", False)}
    assert set(map(tuple, got.collect())) == want == set(map(tuple, E.closed_answers(df, "30 minutes").collect()))


# --- pages ----------------------------------------------------------------------------------------------------------------------------


def test_pages_and_assets(spark):
    rule = K.PAGE_SEPARATOR
    text = f"{{0}} intro here\n# A\none\n{rule}\n\n  {rule}\n{{2}}\nthree\n## B\n|x|y|\n|---|---|\n|1|2|\n|3|4|"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, rule)], "document_id long, text string")
    assert [(r["page_no"], r["text"].split("\n")[0]) for r in K.split_pages(docs).orderBy("page_no").collect()] == [(1, "intro here"), (3, "three")]
    assert [(r["page_no"], r["num_rows"]) for r in K.extract_tables(docs).collect()] == [(3, 2)]
    images = spark.createDataFrame([(1, 1, "i1", "A cat"), (1, 1, "i2", ""), (1, 3, "i1", "again"), (1, 2, "i9", "no page"), (1, 0, "i0", "none")], "document_id long, page_no int, asset_id string, caption string")
    tables = spark.createDataFrame([(1, 3, "t1", "Sums", 2, 2)], "document_id long, page_no int, asset_id string, caption string, num_rows int, num_cols int")
    got = [(r["chunk_index"], r["page_no"], r["heading_path"], r["content"], r["image_refs"], r["table_refs"]) for r in K.chunk_markdown(docs, 64, images, tables).orderBy("chunk_index").collect()]
    assert got == [
        (0, 1, [], "intro here\n\n[Image on page 1]: A cat", ["i1", "i2"], []), (1, 1, ["A"], "one", [], []),
        (2, 3, [], "three\n\n[Table on page 3 (2x2)]: Sums", [], ["t1"]), (3, 3, ["B"], "|x|y|\n|---|---|\n|1|2|\n|3|4|", [], []),
    ]


# --- graph ----------------------------------------------------------------------------------------------------------------------------


def by_hand(chunks, shown):
    """Nodes and edges of the corpus graph, chunk by chunk."""
    name = regex.compile(r"\b(\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}+)*)")
    nodes, edges = {}, {}
    for doc, index, text in sorted(chunks):
        found = list(name.finditer(text or ""))
        own = {}
        for at, m in enumerate(found):
            near = " ".join(text[max(0, m.start(1) - 64) : m.end(1) + 64].split())
            near = near[:177] + "..." if len(near) > 180 else near
            own.setdefault(m[1].lower(), (at, m[1], f"Mentioned as Concept in context: {near}"))
        for low, (at, n, said) in own.items():
            x = nodes.setdefault(low, {"id": n, "docs": set(), "n": 0, "said": {}})
            x["docs"].add(doc)
            x["n"] += 1
            x["said"].setdefault(said, (doc, index, at))
        met = {}
        for at, (a, b) in enumerate(zip(found, found[1:], strict=False)):
            if a[1].lower() != b[1].lower():
                met.setdefault(tuple(sorted((a[1].lower(), b[1].lower()))), (at, a[1], b[1]))
        for pair, (at, a, b) in met.items():
            x = edges.setdefault(pair, {"ends": (a, b), "n": 0, "said": {}})
            x["n"] += 1
            x["said"].setdefault(f"{a} related to {b}.", (doc, index, at))
    told = lambda x: "<SEP>".join(sorted(x["said"], key=lambda s: (x["said"][s], s))[:shown])
    return {(x["id"], "Concept", told(x), len(x["docs"]), x["n"]) for x in nodes.values()}, {(*x["ends"], "related_to", told(x), float(x["n"])) for x in edges.values()}


@pytest.mark.parametrize("shown", [1, 8])
def test_corpus_graph(spark, sf_dir, shown):
    from corpusgraph.plans import standins as S

    chunks = S.chunks(spark, sf_dir)
    nodes, edges = by_hand([(r["document_id"], r["chunk_index"], r["content"]) for r in chunks.collect()], shown)
    g = G.corpus_graph(chunks, shown=shown)
    assert {(r["id"], r["entity_type"], r["description"], r["documents"], r["mentions"]) for r in g["nodes"].collect()} == nodes
    assert {(r["source"], r["target"], r["keywords"], r["description"], r["weight"]) for r in g["edges"].collect()} == edges
    assert g["node_descriptions"].count() >= len(nodes) > 100


def test_graph_of_an_extractor(spark):
    """Scores, ties, thresholds, types, ends that are no mention, either way round, empty and equal ends, nulls."""
    m = lambda name, kind, score, at: (name, kind, score, at, at + len(name))
    rows = [
        (1, 0, "Ada met Bob", [m("Ada", "Person", 0.6, 0), m("ADA", "Robot", 0.9, 0), m("Bob", "Person", 0.4, 8), m("", "Person", 0.9, 0)], [("Ada", "Bob", "met"), ("bob", "ada", "MET"), ("Ada", "Bob", "likes it"), ("Ada", "ada", "is"), ("", "Bob", "x")]),
        (2, 0, "ada", [m("ada", "", 0.9, 0), m("Ada", "Person", None, 0)], [("Ada", "Bob", "met"), ("Eve", "ada", None)]), (3, 0, None, None, None), (4, 0, "none", [], []),
    ]
    g = G.corpus_graph(spark.createDataFrame(rows, G.EXTRACTED), lambda x: x)
    nodes = {r["id"]: (r["entity_type"], r["documents"], r["mentions"]) for r in g["nodes"].collect()}
    assert nodes == {"ADA": ("Robot", 2, 2), "Bob": ("Other", 2, 2), "Eve": ("Other", 1, 1)}
    edges = {(r["source"], r["target"]): (r["keywords"], r["weight"], r["description"]) for r in g["edges"].collect()}
    assert edges == {("Ada", "Bob"): ("likes_it,met", 3.0, "Ada met Bob.<SEP>Ada likes it Bob."), ("Eve", "ada"): ("related_to", 1.0, "Eve related to ada.")}
    told = {r["id"]: r["description"] for r in g["nodes"].collect()}
    assert told["Eve"] == "Entity inferred from relation extraction." and told["ADA"] == "Mentioned as Robot in context: Ada met Bob<SEP>Mentioned as Other in context: ada"
    assert all(x.count() == 0 for x in G.corpus_graph(spark.createDataFrame([], "document_id long, chunk_index int, content string")).values())


@pytest.mark.parametrize("size", [N.AUTOMATON_BYTES, 8])
def test_names_in_text(spark, monkeypatch, size):
    monkeypatch.setattr(N, "AUTOMATON_BYTES", size)
    texts = [(1, "she sells seashells"), (2, None), (None, "he"), (3, ""), (4, "né x" * 20_000), (1, "hers")]
    names = ["he", "she", "hers", "sell", "seashell", "né", "é x", "", None, "he"]
    got = sorted(map(tuple, N.names_in_text(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()), key=repr)
    assert got == sorted(((k, n) for k, t in texts if t for n in {n for n in names if n} if n in t), key=repr)
    none = spark.createDataFrame([], "k long, t string")
    assert N.names_in_text(none, "k", "t", spark.createDataFrame([("a",)], "n string"), "n").collect() == []
    assert N.names_in_text(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([], "n string"), "n").collect() == []


# --- smaller things -------------------------------------------------------------------------------------------------------------------


def form(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f").replace("đ", "d").replace("Đ", "d").lower()
    return " ".join(regex.sub(r"[^a-z0-9\s]", " ", t).split())


@pytest.mark.parametrize("text", ["cafés não", "Tiếng Việt Đặng", "ǖ Ǆ ﬁ ½ Å ℌ Ω", "ậb", "İstanbul Łódź ß", "", "!!"])
def test_match_form(spark, text):
    got = spark.createDataFrame([(text,)], "c string").select(T.match_form("c").alias("x"), T.heading_slug("c").alias("s")).first()
    assert got["x"] == form(text) and got["s"] == form(text).replace(" ", "-")[:80]


def locate_by_hand(needle, blocks):
    needle = form(needle or "")
    if not needle:
        return None
    hays = [(n, form(b or "")) for n, b in sorted(blocks)]
    if (hit := next((n for n, h in hays if needle in h), None)) is not None:
        return hit, 1000
    words = list(dict.fromkeys(w for w in needle.split() if len(w) >= 4))[:12]
    best = max(((sum(w in h for w in words), -n) for n, h in hays), default=(0, 0))
    return (-best[1], best[0]) if words and best[0] >= max(2, -(-len(words) * 4 // 10)) else None


def test_locate_passage(spark):
    blocks = ["Résumé détaillé des quatre cinq parties", "resume of other things entirely", "", None, "Nation and station rationales", "a b c", "detaille quatre resumes", "xa by"]
    needles = ["Resume detaille quatre", "resumé DÉTAILLÉ quatre cinq fehlt hier", "tion ration nothing", "a b", "b", "zz", "", None, "quatre missing", "station", "rationales entirely resume", "detaille"]
    hay = spark.createDataFrame([(d, i, b) for d in (1, 2) for i, b in enumerate(blocks[: 8 if d == 1 else 2])], "document_id long, block_no int, content string")
    ask = spark.createDataFrame([(10 * d + 1000 * i, d, n) for d in (1, 2, 3) for i, n in enumerate(needles)], "needle_id long, document_id long, needle string")
    got = {r["needle_id"]: (r["block_no"], r["score"]) for r in D.locate_passage(ask, hay).collect()}
    want = {10 * d + 1000 * i: x for d in (1, 2) for i, n in enumerate(needles) if (x := locate_by_hand(n, list(enumerate(blocks[: 8 if d == 1 else 2]))))}
    assert got == want and len(want) > 6


def test_locate_passage_fuzzy_in_documents(spark, sf_dir):
    """Every third word of each line, in its document, against every block by hand."""
    docs = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()}
    ask = [(1_000 * d + i, d, " ".join(line.split()[::3][:14])) for d, lines in docs.items() for i, line in enumerate(lines)]
    hay = spark.createDataFrame([(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "document_id long, block_no int, content string")
    got = {r["needle_id"]: (r["block_no"], r["score"]) for r in D.locate_passage(spark.createDataFrame(ask, "needle_id long, document_id long, needle string"), hay).collect()}
    want = {k: x for k, d, n in ask if (x := locate_by_hand(n, list(enumerate(docs[d]))))}
    assert got == want and sum(s < 1000 for _, s in want.values()) > 100


def test_clean_answers(spark):
    rows = [('<think>x</think><tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call> Text [1].',), ("<tool_call>{bad</tool_call> stays",), (None,), ("",)]
    got = [(r["tool_call"] and r["tool_call"]["name"], r["clean"]) for r in C.clean_answers(spark.createDataFrame(rows, "content string")).collect()]
    assert got[0] == ("f", "Text [1].") and got[1][0] is None and "{bad" in got[1][1]


def test_ties_of_turn(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "user", "c"), (1, None, "user", "first")], "conv_id long, turn int, role string, content string")
    got = {r["content"]: [x["content"] for x in r["history"]] for r in C.history_window(m).collect()}
    assert got == {"first": [], "b": ["first"], "a": ["first", "b"], "c": ["first", "b", "a"]}


def test_near_copies_in_order(spark):
    """What is judged where the chunks lie is what pairs and their order give: groups, chains, short, empty and null contents."""
    import random

    from corpusgraph.operators import dedup

    rng, rows = random.Random(4), []
    for doc in range(25):
        base = [" ".join("".join(rng.choices("abcde", k=4)) for _ in range(30)) for _ in range(3)]
        for i in range(rng.randrange(1, 14)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=3))
            rows.append((doc, i, rng.choice([" ".join(words), " ".join(words).upper(), "abc", "abd", "", None, "Añb"] if i % 4 == 3 else [" ".join(words)])))
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, content string")
    for t in (0.6, 0.85, 1.0):
        want = sorted(map(tuple, dedup.near_losers(dedup.near_pairs(df, t)).collect()))
        assert sorted(map(tuple, dedup.near_losers_in_order(df, t).collect())) == want and len(want) > 10
    assert dedup.near_losers_in_order(df.limit(0)).collect() == []
