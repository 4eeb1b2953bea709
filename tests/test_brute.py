"""Queries that SQL cannot express, over whole tables, and rules at their edges, against plain Python."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import chunking as K
from corpusgraph.operators import graph as G
from corpusgraph.operators import retrieval as R
from corpusgraph.plans import registered

QUERIES = registered()[0]


def test_graph_of_chunks(spark, sf_dir):
    name = regex.compile(r"\b(\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}+)*)")
    seen, ties = {}, Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for line in (r["text"] or "").split("\n"):
            names = name.findall(line)
            for x in names:
                seen.setdefault(x, set()).add(r["doc_id"])
            ties.update(tuple(sorted(p)) for p in zip(names, names[1:], strict=False) if p[0] != p[1])
    want = {("node", x, "", len(ids)) for x, ids in seen.items()} | {("edge", a, b, n) for (a, b), n in ties.items()}
    assert {(r["kind"], r["a"], r["b"], r["n"]) for r in QUERIES["g5_build_graph"](spark, sf_dir).collect()} == want


def test_embedding_inputs(spark, sf_dir):
    rows = QUERIES["tx4_embedding_inputs"](spark, sf_dir).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["document_id"], r["chunk_index"], r["part"])):
        whole.setdefault((r["document_id"], r["chunk_index"]), []).append(r["input"])
        assert 0 < len(r["input"]) <= 1600
    want = {(r["doc_id"], i): line.strip() or "[empty]" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, line in enumerate((r["text"] or "").split("\n"))}
    assert set(whole) == set(want)
    for key, parts in whole.items():
        assert set(" ".join(parts).split()) == set(want[key].split()) or any(len(p) == 1600 for p in parts)


def test_recursive_pieces(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {}
    for r in QUERIES["c1_chunk_recursive"](spark, sf_dir).collect():
        pieces.setdefault(r["document_id"], []).append(r)
    assert set(pieces) == {i for i, t in docs.items() if t and t.strip()}
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["total_chunks"] for r in rows} == {len(rows)}
        assert all(len(r["content"]) <= 500 and docs[i][r["char_start"] :].startswith(r["content"][:50]) for r in rows)
        words = lambda t: set(regex.split(r"[\s.]+", t))
        assert words(" ".join(r["content"] for r in rows)) >= words(docs[i]) - {""}


@pytest.mark.parametrize("text, limit, want", [
    ("Intro.\n\n" + "One two three four. " * 3 + "\n\nOut.", 12, ["Intro.", "One two three four. One two three four.", "One two three four. \n\nOut."]),
    ("short", 12, ["short"]), ("", 12, [""]), (None, 12, None), ("\n\n" * 40, 12, ["\n\n" * 40]), ("a" * 60 + "\n\nb", 12, ["a" * 60, "b"]),
    ("a b\n\nc d\n\n" + "e" * 45, 12, ["a b\n\nc d", "e" * 45]),
])
def test_pack_paragraphs(spark, text, limit, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(K.pack_paragraphs(F.col("c"), limit).alias("x")).first()["x"] == want


@pytest.mark.parametrize("text, want", [
    ("<triplet> A b <per> C <org> works at <loc> D <loc> lives in</s>", [("A b", "per", "C", "org", "works at"), ("A b", "loc", "D", "loc", "lives in")]),
    ("tp_XX<s><triplet> A <per> B <per> knows <triplet> C <org> D <loc> sits in <pad>", [("A", "per", "B", "per", "knows"), ("C", "org", "D", "loc", "sits in")]),
    ("<triplet> A <per> B", []), ("words alone", []), ("", []), (None, None),
])
def test_decode_triplets(spark, text, want):
    got = spark.createDataFrame([(text,)], "c string").select(G.decode_triplets(F.col("c")).alias("x")).first()["x"]
    assert (got and [tuple(r) for r in got]) == want


@pytest.mark.parametrize("value, kind, want", [
    ("Works At", "relation", "Works_At"), (" \n", "relation", "related_to"), (None, "relation", "related_to"), ("a_b\tc", "keywords", "a b c"), ("", "keywords", "related to"),
    ("x<|#|>y<|COMPLETE|>", "field", "x y"), ("<|other|>", "field", "<|other|>"), (None, "type", "Other"),
])
def test_record_fields(spark, value, kind, want):
    assert spark.createDataFrame([(value,)], "c string").select(T.sanitize_kg_field("c", kind).alias("x")).first()["x"] == want


def bm25_by_hand(chunks, question, k):
    words = {i: (t or "").lower().split() for i, t in chunks}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = {i: sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for q in question.lower().split()) for i, ws in words.items()}
    return sorted(words, key=lambda i: (-round(score[i], 9), i))[:k]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_with_common_words(spark, k):
    """Words of most chunks have a negative weight, so chunks without them come first."""
    chunks = [(i, "a b") for i in range(5)] + [(5, "c"), (6, None), (7, ""), (8, "a a c d")]
    asked = {1: "a", 2: "zzz", 3: "c d", 4: "a b c", 5: ""}
    df = spark.createDataFrame(chunks, "chunk_id long, content string")
    got = R.bm25_search(df, spark.createDataFrame(list(asked.items()), "query_id long, question string"), k).collect()
    for q, text in asked.items():
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == bm25_by_hand(chunks, text, k)


def test_bm25_broadcast_or_not(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, QUERIES["l3_bm25_search"](spark, sf_dir).collect()))
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, QUERIES["l3_bm25_search"](spark, sf_dir).collect())) == want
    empty = spark.createDataFrame([], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, question string")
    assert R.bm25_search(empty, asked, 3).collect() == []
    assert R.bm25_search(empty.unionByName(spark.createDataFrame([(1, "a")], empty.schema)), asked.limit(0), 3).collect() == []


def test_embed_falls_back(spark):
    def model(rows):
        if any("bad" in r for r in rows):
            raise ValueError("no")
        return [[float(len(r)), float("nan")] for r in rows]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(1, 9)], "k long, content string").coalesce(1)
    got = {r["k"]: (r["embedding"], r["embed_error"]) for r in R.embed(df, model, 2, batch=4).collect()}
    assert got[3] == ([0.0, 0.0], "ValueError: no") and all(got[i] == ([1.0, 0.0], None) for i in got if i != 3)  # of length 1


def test_citation_ids_differ(spark):
    rows = spark.range(300).select(T.citation_ids("id", F.lit(60)).alias("ids"), T.citation_id("id", F.lit(1)).alias("first")).collect()
    assert all(len(set(r["ids"])) == 60 and r["ids"][0] == r["first"] and None not in r["ids"] for r in rows)


def test_chat_contexts(spark, sf_dir):
    """Sources of a question in order, each under its label."""
    got = {r["query_id"]: r["context"] for r in QUERIES["x3_chat_context"](spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hits = {}
    for r in sorted(QUERIES["rr1_rerank"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        hits.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert set(got) == set(hits)
    for q, ids in hits.items():
        want, rest = [], got[q]
        for i in ids:
            inner = ", ".join([f"doc_{i}"] + [f"page {i % 3}"] * (i % 3 > 0) + ["A > B"] * (i % 2 == 0))
            head = regex.match(r"Source \[([a-z][a-z0-9]{3})\] ", rest)
            body = f"({inner}):\n{docs[i]}"
            assert head and rest[head.end() :].startswith(body)
            want.append(head[1])
            rest = rest[head.end() + len(body) :].removeprefix("\n\n")
        assert rest == "" and len(set(want)) == len(want)


def test_context_of_nothing(spark):
    hits = spark.createDataFrame([], "query_id long, rank int, content string, file string, page_no int, heading_path array<string>")
    asked = spark.createDataFrame([(1, "x")], "query_id long, question string")
    assert [tuple(r) for r in R.assemble_context(hits, queries=asked).collect()] == [(1, R.NOTHING_FOUND)]


def ids_of(e):
    return [x for x in (e["data"] or "").split("|") if x]


def micros(a, b):
    return round((b - a).total_seconds() * 1_000_000)


def stored_steps(events):
    """The stored steps of a session, event by event."""
    steps, sources, images = [], [], []

    def found(ts):
        steps.append({"name": "sources_found", "ts": ts, "n": len(sources), "i": len(images), "b": list(dict.fromkeys(sources[:6]))})

    for e in events:
        if e["event"] == "status":
            if e["data"] == "generating" and sources:
                found(e["ts"])
                sources, images = [], []
            steps.append({"name": e["data"], "ts": e["ts"]})
        elif e["event"] == "sources":
            sources += ids_of(e)
        elif e["event"] == "images":
            images += ids_of(e)
        elif e["event"] == "thinking" and (first := next((s for s in steps if s["name"] == "analyzing"), None)):
            first["t"] = first.get("t", "") + e["data"]
        elif e["event"] == "complete":
            if sources and not any(s["name"] == "sources_found" for s in steps):
                found(e["ts"])
            steps.append({"name": "done", "ts": e["ts"]})
            break  # nothing follows an answer
    ends = [s["ts"] for s in steps[1:]]
    return [(k + 1, s["name"], s.get("n"), s.get("i"), s.get("b"), s.get("t"), micros(s["ts"], ends[k]) if k < len(ends) else None) for k, s in enumerate(steps)]


def shown_steps(events):
    """The steps a client shows, event by event."""
    steps = []

    def end(ts, status="completed"):
        for s in steps:
            if s["status"] == "active":
                s["status"] = status
                s["d"] = micros(s["ts"], ts) if status == "completed" else None

    def add(name, e, status="completed", **more):
        steps.append({"name": name, "ts": e["ts"], "status": status, **more})

    for e in events:
        if e["event"] == "status" and e["data"] in ("analyzing", "retrieving", "generating"):
            if e["data"] != "analyzing":
                end(e["ts"])
            if e["data"] == "retrieving":
                add("understood", e)
            add(e["data"], e, "active")
        elif e["event"] == "sources":
            end(e["ts"])
            add("sources_found", e, n=len(ids_of(e)), i=0, b=ids_of(e))
        elif e["event"] == "images":
            if last := next((s for s in reversed(steps) if s["name"] == "sources_found"), None):
                last["i"] += len(ids_of(e))
        elif e["event"] == "complete":
            end(e["ts"])
            add("done", e, total=micros(events[0]["ts"], e["ts"]))
        elif e["event"] == "error":
            end(e["ts"], "error")
    return [(k + 1, s["name"], s["status"], s.get("d"), s.get("n"), s.get("i"), s.get("b"), s.get("total")) for k, s in enumerate(steps)]


def sessions_of(spark, sf_dir):
    from corpusgraph.plans.chat_queries import agent_log

    events = {}
    for e in agent_log(spark, sf_dir).orderBy("seq").collect():
        events.setdefault(e["session"], []).append(e)
    return events


def grouped(rows, columns):
    out = {}
    for r in sorted(rows, key=lambda r: r["step"]):
        out.setdefault(r["session"], []).append(tuple(r[c] for c in columns))
    return out


def test_stored_steps(spark, sf_dir):
    """One answer a session: its events end with the first complete."""
    from corpusgraph.operators import chat as C

    whole = sessions_of(spark, sf_dir)
    cut = {s: es[: next((k + 1 for k, e in enumerate(es) if e["event"] == "complete"), len(es))] for s, es in whole.items()}
    rows = [tuple(e) for es in cut.values() for e in es]
    schema = "session string, seq long, event string, data string, ts timestamp_ntz"
    got = grouped(C.agent_timeline(spark.createDataFrame(rows, schema)).collect(), ("step", "name", "n_sources", "n_images", "badges", "thinking", "duration"))
    assert got == {s: x for s, es in cut.items() if (x := stored_steps(es))}
    assert any(r[1] == "sources_found" for x in got.values() for r in x)


def test_shown_steps(spark, sf_dir):
    got = grouped(QUERIES["st2b_client_timeline"](spark, sf_dir).collect(), ("step", "name", "status", "duration", "n_sources", "n_images", "badges", "total"))
    assert got == {s: x for s, es in sessions_of(spark, sf_dir).items() if (x := shown_steps(es))}


def test_profile_counts(spark, sf_dir):
    """The counts agree with the noise filter's reasons chunk by chunk."""
    from corpusgraph.operators.dedup import filter_noise
    from corpusgraph.plans import standins as S

    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = Counter((source[r["document_id"]], r["drop_reason"] or "kept") for r in filter_noise(S.chunks(spark, sf_dir)).collect())
    assert {(r["workspace"], r["reason"]): r["n"] for r in QUERIES["tx1_profile_counts"](spark, sf_dir).collect()} == dict(want)


def test_rows_are_numbered_in_order(spark):
    """Ties, nulls and several ranges; an empty table gives none."""
    from corpusgraph.operators.chat import numbered_rows

    df = spark.range(5000).selectExpr("id % 700 as a", "case when id % 9 > 0 then id end as b")
    got = numbered_rows(df, "n", "a", "b").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 5001))
    by_n = [(r["a"], -1 if r["b"] is None else r["b"]) for r in sorted(got, key=lambda r: r["n"])]
    assert by_n == sorted(by_n)
    assert numbered_rows(df.limit(0), "n", "a").collect() == []
