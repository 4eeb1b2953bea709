"""Registered queries of pages and assets, ingest, streams that close, user turns and small functions, each with its SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from corpusgraph.functions import metrics as M
from corpusgraph.functions import segment
from corpusgraph.functions import text as T
from corpusgraph.operators import chat as C
from corpusgraph.operators import chunking as K
from corpusgraph.operators import documents
from corpusgraph.operators import retrieval as R
from corpusgraph.sources import batches, files
from corpusgraph.sources.shared import scratch, write_table
from corpusgraph.streaming import events as E

from . import standins as S
from .chat_queries import LOG, MD, SECTIONS, STATUS, _packed, log, markdown, status_log
from .retrieval_queries import _TOK, KEYWORD_RANKED, _reranked, corpus, questions

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# --- pages -------------------------------------------------------------------------------------------------------------------------


def paged(spark, d):
    """The Markdown documents, a page for each six of their chunks."""
    line = F.when(F.col("chunk_index") % 6 == 0, F.concat(F.lit("# H"), F.col("chunk_index").cast("string"))).when(F.col("chunk_index") % 6 == 2, F.concat(F.lit("## S"), F.col("chunk_index").cast("string")))
    line = line.when(F.col("chunk_index") % 6 == 4, "|a|b|\n|---|---|\n|1|2|").otherwise(F.col("content"))
    rule = F.when((F.col("chunk_index") % 6 == 0) & (F.col("chunk_index") > 0), K.PAGE_SEPARATOR + "\n").otherwise("")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.concat(rule, line).alias("l")))), lambda x: x["l"])
    return S.chunks(spark, d).groupBy("document_id").agg(F.array_join(lines, "\n").alias("text"))


@query("w7_page_lines", f"WITH {MD}, e AS (SELECT document_id, CAST(i // 6 + 1 AS INT) AS page_no, unnest(CASE WHEN i % 6 = 4 THEN ['|a|b|', '|---|---|', '|1|2|'] ELSE [line] END) AS line FROM md) SELECT document_id, page_no, line FROM e")
def _(spark, d):
    return K.page_lines(K.lines_of(paged(spark, d))).select("document_id", "page_no", "line")


@query("c7_table_pages", f"WITH {MD} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INT) AS table_no, CAST(i // 6 + 1 AS INT) AS page_no, 1 AS num_rows, 2 AS num_cols FROM md WHERE i % 6 = 4")
def _(spark, d):
    return K.extract_tables(paged(spark, d)).select("document_id", "table_no", "page_no", "num_rows", "num_cols")


CHUNK_PAGES = f"""{SECTIONS}, p AS (SELECT document_id, h, coalesce(sub, h) AS spot, path, {_packed("content", 256)} AS pieces FROM sections),
u AS (SELECT document_id, h, spot, path, i, pieces[i] AS content FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM p)),
n AS (SELECT *, CAST(h // 6 + 1 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY document_id ORDER BY spot, i) - 1 AS INT) AS chunk_index FROM u),
f AS (SELECT *, chunk_index = min(chunk_index) OVER (PARTITION BY document_id, page_no) AS first FROM n),
t AS (SELECT document_id, CAST(i // 6 + 1 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INT) AS table_no FROM md WHERE i % 6 = 4)"""


@query("c4_chunk_pages", f"""WITH {CHUNK_PAGES}, {S.ASSETS} SELECT f.document_id, chunk_index, f.page_no, path, content
  || CASE WHEN first AND asset_id IS NOT NULL THEN chr(10) || chr(10) || '[Image on page ' || f.page_no || ']: ' || caption ELSE '' END
  || CASE WHEN first AND table_no IS NOT NULL THEN chr(10) || chr(10) || '[Table on page ' || f.page_no || ' (1x2)]: Table ' || table_no ELSE '' END AS content,
  CASE WHEN first THEN asset_id END AS image, CASE WHEN first AND table_no IS NOT NULL THEN 'tab-' || f.document_id || '-' || table_no END AS tab
FROM f LEFT JOIN assets ON first AND assets.document_id = f.document_id AND assets.page_no = f.page_no LEFT JOIN t ON first AND t.document_id = f.document_id AND t.page_no = f.page_no""")  # fmt: skip
def _(spark, d):
    docs = paged(spark, d)
    tables = K.extract_tables(docs).select("document_id", "page_no", F.format_string("tab-%d-%d", "document_id", "table_no").alias("asset_id"), F.format_string("Table %d", "table_no").alias("caption"), "num_rows", "num_cols")
    c = K.chunk_markdown(docs, 64, S.assets(spark, d), tables)
    return c.select("document_id", "chunk_index", "page_no", F.array_join("heading_path", " > ").alias("path"), "content", F.get("image_refs", F.lit(0)).alias("image"), F.get("table_refs", F.lit(0)).alias("tab"))


# --- ingest and replacement --------------------------------------------------------------------------------------------------------


def ingested(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query("st5_ingest_chunks", None)
def _(spark, d):
    return E.ingest_chunks(spark, ingested(spark, d)).select("document_id", "chunk_index", "old_index", "page_no", "content", "embedding")


@query("st6_replaced_documents", f"WITH {S.CHUNKS} SELECT document_id, chunk_index, CASE WHEN document_id % 3 = 1 THEN content || ' again' ELSE content END AS content FROM chunks WHERE document_id % 3 > 0 OR document_id % 2 = 0")
def _(spark, d):
    """Lines of all documents; a second batch changes those of every third and drops others."""
    c, path = S.chunks(spark, d).select("document_id", "chunk_index", "content"), scratch(spark, "replaced")
    E.replace_documents(spark, c, path, 1)
    part = c.filter("document_id % 3 = 1 or document_id % 6 = 3")
    for _ in range(2):  # a batch may run twice
        E.replace_documents(spark, part.filter("document_id % 3 = 1").withColumn("content", F.concat("content", F.lit(" again"))), path, 2, part.select("document_id").distinct())
    return E.read_documents(spark, path).drop("batch")


@query("io5_vector_collection", "SELECT label AS workspace, vec_id AS chunk_id, CASE WHEN label % 4 = 0 THEN 32 ELSE 64 END AS dim, CASE WHEN label % 2 = 1 AND vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE embedding[1]::DOUBLE END AS x FROM embeddings WHERE label % 4 > 0 OR vec_id % 3 = 0")
def _(spark, d):
    """Labels are workspaces. A second write changes every third vector of odd ones and gives those of label 0, 4, 8 another dimension."""
    path = scratch(spark, "collection")
    v = S.table(spark, d, "embeddings").select(F.col("label").alias("workspace"), F.col("vec_id").alias("chunk_id"), "embedding")
    files.write_vectors(v, path, batch=1)
    third = v.filter("chunk_id % 3 = 0")
    odd = third.filter("workspace % 2 = 1").withColumn("embedding", F.transform("embedding", lambda _: F.lit(1.0).cast("float")))
    half = third.filter("workspace % 4 = 0").withColumn("embedding", F.slice("embedding", 1, 32))
    files.write_vectors(odd.unionByName(half), path, batch=2)
    return files.read_vectors(spark, path).select("workspace", "chunk_id", F.size("embedding").alias("dim"), F.get("embedding", F.lit(0)).cast("double").alias("x"))


@query("st6_compacted", f"WITH {S.DOCS} SELECT id AS document_id, chunk_count AS n FROM docs")
def _(spark, d):
    """Documents written in three batches and then as one."""
    path, to = scratch(spark, "batches"), scratch(spark, "compacted")
    c = S.chunks(spark, d).select("document_id", "chunk_index")
    for n in range(3):
        batches.put_batch(c.filter(F.col("document_id") % 3 >= n), path, E.DOCUMENT, n)
    batches.compact(spark, path, to, E.DOCUMENT)
    return E.read_documents(spark, to).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


# --- compounds ---------------------------------------------------------------------------------------------------------------------


def compounds(spark, d):
    return segment.learn_compounds(corpus(spark, d), 4, 2.0)


@query("s20_compounds", f"WITH t AS MATERIALIZED (SELECT {_TOK.format('text')} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT a, count(*) AS n FROM (SELECT unnest(w) AS a FROM t) GROUP BY a), p AS (SELECT x.a AS a, x.b AS b, count(*) AS n FROM (SELECT unnest(list_transform(w[1:len(w) - 1], lambda v, i: {{'a': v, 'b': w[i + 1]}})) AS x FROM t WHERE len(w) > 1) GROUP BY ALL), z AS (SELECT sum(len(w)) AS words, sum(greatest(len(w) - 1, 0)) AS pairs FROM t) SELECT p.a || ' ' || p.b AS compound, p.n, round(ln(p.n / pairs) - ln(x.n / words) - ln(y.n / words), 6) AS pmi FROM p JOIN s AS x ON x.a = p.a JOIN s AS y ON y.a = p.b, z WHERE p.n >= 4 AND ln(p.n / pairs) - ln(x.n / words) - ln(y.n / words) >= 2.0")
def _(spark, d):
    return compounds(spark, d).withColumn("pmi", F.round("pmi", 6))


@query("s20_segmented_search", None)
def _(spark, d):
    """BM25 in which the corpus' own compounds are one term each."""
    known = write_table(compounds(spark, d).select("compound"), "known-compounds")
    chunks = write_table(segment.join_compounds(corpus(spark, d).select("chunk_id", "content"), "content", known), "segmented")
    return R.bm25_search(chunks, segment.join_compounds(questions(spark, d), "question", known), 10)


# --- streams that close --------------------------------------------------------------------------------------------------------------

CLOSED = f"""{LOG}, g AS (SELECT *, lag(event) OVER w AS before, epoch_ms(ts) AS ms, epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS gap FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
parts AS (SELECT *, sum(CASE WHEN before IS NULL OR before = 'complete' OR gap > 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, seq) AS part FROM g),
cuts AS (SELECT *, max(CASE WHEN event = 'token_rollback' THEN seq END) OVER (PARTITION BY session, part) AS cut FROM parts)
SELECT session, min(seq) AS first_seq, max(seq) AS last_seq, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE event = 'token' AND seq > coalesce(cut, -1)), '') AS answer, max(event = 'complete') AS done FROM cuts GROUP BY session, part"""


def ticked(spark, d):
    """The log, and a tick a day after its end."""
    events = log(spark, d)
    end = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit("").alias("session"), F.lit(-1).cast("long").alias("seq"), "ts", F.lit(E.TICK).alias("event"), F.lit(None).cast("string").alias("data"))
    return events.unionByName(end)


@query("st1_closed_answers", f"WITH {CLOSED}")
def _(spark, d):
    return E.closed_answers(ticked(spark, d), "12 hours")


@query("st1_closed_answers_stream", f"WITH {CLOSED}")
def _(spark, d):
    return E.run_appended(spark, E.closed_answers_stream(E.replay_in_order(ticked(spark, d), "ts"), "12 hours"))[0]


FAILING = "(CASE WHEN event_id % 5 = 4 THEN repeat('e' || event_id || ' ', 150) END)"


@query("st3_status_with_errors_stream", f"WITH {STATUS}, x AS (SELECT st.*, {FAILING} AS error FROM st JOIN events ON event_id = seq), l AS (SELECT document_id, arg_max({{'s': status, 'e': error}}, {{'ts': ts, 'seq': seq}}) AS last, max(epoch_us(ts)) FILTER (WHERE status = 'INDEXED') - min(epoch_us(ts)) FILTER (WHERE status = 'PARSING') AS elapsed_us FROM x GROUP BY document_id) SELECT document_id, last.s AS status, elapsed_us, CASE WHEN last.s = 'FAILED' THEN left(last.e, 500) END AS error FROM l")
def _(spark, d):
    events = status_log(spark, d).withColumn("error", F.when(F.col("status") == "FAILED", F.repeat(F.concat(F.lit("e"), F.col("seq").cast("string"), F.lit(" ")), 150)))
    return E.run_to_table(spark, E.document_status_stream(E.replay(events)), ["document_id"], "version").select("document_id", "status", "elapsed_us", "error")


@query("st4_stale_documents_stream", f"WITH {STATUS}, g AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY document_id ORDER BY ts, seq) AS gap FROM st), i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ts, seq) AS part FROM g), l AS (SELECT document_id, arg_max({{'s': status, 'us': us}}, {{'ts': ts, 'seq': seq}}) AS last FROM i GROUP BY document_id, part) SELECT document_id, last.us AS last_us, 'FAILED' AS status FROM l WHERE last.s IN ('PARSING', 'PROCESSING', 'INDEXING') AND last.us + 600000000 <= (SELECT max(epoch_ms(ts)) * 1000 FROM st)")
def _(spark, d):
    log_ = status_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return E.run_appended(spark, E.stale_documents_stream(E.replay_in_order(log_, "ts")))[0].select("document_id", F.unix_micros("last_ts").alias("last_us"), "status")


# --- turns, lists and small functions --------------------------------------------------------------------------------------------------


@query("x4_user_turns", f"""WITH {S.MESSAGES}, {S.ASSETS}, h AS (SELECT *, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(content, 300), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM messages),
im AS (SELECT document_id, string_agg('- ' || asset_id, chr(10) ORDER BY page_no) AS lines FROM assets GROUP BY document_id)
SELECT conv_id, turn, concat_ws(chr(10), 'I have retrieved the following document sources for you.' || chr(10) || chr(10) || '=== DOCUMENT SOURCES ===' || chr(10) || coalesce(text, '') || chr(10) || '=== END SOURCES ===' || chr(10),
  'Document Images:' || chr(10) || lines || chr(10), 'Answer from the sources.' || chr(10), 'CONVERSATION CONTEXT (previous exchange):' || chr(10) || before || chr(10), 'My question: ' || content) AS prompt
FROM h LEFT JOIN documents ON doc_id = conv_id AND turn % 3 = 0 LEFT JOIN im ON im.document_id = conv_id WHERE role = 'user'""")  # fmt: skip
def _(spark, d):
    m = S.messages(spark, d)
    turns = m.select("conv_id", "turn")
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    shown = S.assets(spark, d).select(F.col("document_id").alias("conv_id"), F.col("page_no").alias("place"), F.concat(F.lit("- "), "asset_id").alias("line"))
    return C.build_user_turns(m, turns.filter("turn % 3 = 0").join(docs, "conv_id"), turns.join(shown, "conv_id"), "Answer from the sources.")


@query("x2_context_chunks", f"WITH {KEYWORD_RANKED} SELECT query_id, string_agg('[Source: ' || CASE WHEN chunk_id % 4 = 0 THEN 'Unknown' ELSE 'doc_' || chunk_id END || ', Chunk ' || rank || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ranked GROUP BY query_id")
def _(spark, d):
    return R.assemble_context_chunks(_reranked(spark, d).withColumn("file", F.when(F.col("chunk_id") % 4 > 0, F.col("file"))))


@query("m1_missing_keywords", "SELECT doc_id, array_to_string(list_filter(['The', 'und', 'zzz', lang], lambda k: NOT contains(lower(text), lower(k))), ',') AS missing FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return S.table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(M.missing_keywords("text", F.array(F.lit("The"), F.lit("und"), F.lit("zzz"), F.col("lang"))), ",").alias("missing"))


@query("m12_contexts_in_order", f"WITH {S.CHUNKS}, n AS (SELECT document_id, max(chunk_index) AS last FROM chunks GROUP BY document_id), o AS (SELECT *, row_number() OVER (ORDER BY document_id) AS n FROM n), c AS (SELECT document_id, list_transform(list_filter([last, 0, 999999, last], lambda i: i <= last), lambda i: i) AS spots FROM o), t AS (SELECT document_id, list(left(content, 500) ORDER BY chunk_index) AS texts FROM chunks GROUP BY document_id) SELECT 'RAGAS-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id, array_to_string(list_transform(spots, lambda i: texts[i + 1]), '~') AS contexts FROM o JOIN c USING (document_id) JOIN t USING (document_id)")
def _(spark, d):
    """Each document asks with its last line, its first, one that is not there, and its last again."""
    chunks = S.chunks(spark, d).select(F.col("document_id").alias("batch"), F.col("chunk_index").alias("place"), "content")
    last = chunks.groupBy("batch").agg(F.max("place").alias("last"))
    items = last.select("batch", F.lit(0).alias("place"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.array("last", F.lit(0), F.lit(999_999), "last").alias("context_indices"))
    return C.resolve_contexts(items, chunks).select("id", F.array_join("contexts", "~").alias("contexts"))


@query("s15_decomposed", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(text, 'ß', ' '))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_form FROM documents")
def _(spark, d):
    """Accents written as marks of their own."""
    t = F.col("text")
    for whole in "éèêíóñäöüçÉÀÑÖ":
        t = F.replace(t, F.lit(whole), F.lit(unicodedata.normalize("NFD", whole)))
    return S.table(spark, d, "documents").select("doc_id", T.match_form(t).alias("match_form"))


@query("tx2_tool_calls", f"WITH {S.MESSAGES} SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'search' END AS call, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS clean FROM messages WHERE trim(content) <> ''")
def _(spark, d):
    call = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('<tool_call>{"name": "search", "arguments": {"q": '), F.col("turn").cast("string"), F.lit("}}</tool_call>\n"))).otherwise("")
    m = S.messages(spark, d).filter("trim(content) <> ''").withColumn("content", F.concat(F.lit("<think>so</think>"), call, "content"))
    return C.clean_answers(m).select("conv_id", "turn", F.col("tool_call.name").alias("call"), F.trim("clean").alias("clean"))


@query("tx3_relinked_images", f"WITH {S.DOCS} SELECT id, CASE WHEN image_count > 0 THEN '![a](/static/doc-images/kb_' || workspace || '/images/img-' || id || '-0.png)' ELSE '![a](img-' || id || '-0)' END || CASE WHEN image_count > 1 THEN '![b](/static/doc-images/kb_' || workspace || '/images/img-' || id || '-1.png)' ELSE '![b](img-' || id || '-1)' END || text AS text FROM docs")
def _(spark, d):
    link = lambda n, k: F.format_string(f"![{n}](img-%d-{k})", "id")
    docs = S.docs(spark, d).withColumn("text", F.concat(link("a", 0), link("b", 1), "text"))
    return documents.link_assets(docs, S.assets(spark, d))


@query("p7_split_sources", "SELECT conv_id, count(*) FILTER (WHERE turn % 3 > 0) AS vector, count(*) FILTER (WHERE turn % 3 = 0) AS kg FROM conversations GROUP BY conv_id")
def _(spark, d):
    kind = F.when(F.col("turn") % 3 > 0, "vector").otherwise("kg")
    m = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(kind.alias("type"), "turn")).alias("sources"))
    return m.select("conv_id", C.split_sources("sources").alias("s")).select("conv_id", F.size("s.vector").cast("bigint").alias("vector"), F.size("s.kg").cast("bigint").alias("kg"))


@query("s23_mention_context", f"WITH {S.CHUNKS}, m AS (SELECT document_id, chunk_index, content, length(content) // 2 AS a FROM chunks), n AS (SELECT *, regexp_replace(regexp_replace(substring(content, greatest(a - 64, 0) + 1, a + 5 + 64 - greatest(a - 64, 0)), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS near FROM m) SELECT document_id, chunk_index, 'Mentioned as Word' || CASE WHEN near = '' THEN ' in the source text.' ELSE ' in context: ' || CASE WHEN length(near) > 180 THEN left(near, 177) || '...' ELSE near END END AS description FROM n")
def _(spark, d):
    at = F.floor(F.length("content") / 2).cast("int")
    return S.chunks(spark, d).select("document_id", "chunk_index", T.mention_context("content", at, at + 5, F.lit("Word")).alias("description"))


@query("s39_s42_dividers_and_types", "SELECT doc_id, text || chr(10) || chr(10) || '<!-- page ' || (doc_id % 7) || ' -->' || chr(10) || chr(10) || lang AS divided, CASE WHEN doc_id % 3 = 0 THEN 'Person,Place' ELSE lang || ',' || source END AS types FROM documents WHERE NOT regexp_matches(text, '\\n$')")
def _(spark, d):
    docs = S.table(spark, d, "documents").filter(~F.col("text").rlike("\n$"))
    divided = F.concat("text", F.lit("\n{"), (F.col("doc_id") % 7).cast("string"), F.lit("}" + "-" * 48 + "\n"), "lang")
    types = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.col("source"), F.concat("lang", F.lit(" "))))
    return docs.select("doc_id", T.normalize_page_dividers(divided).alias("divided"), F.array_join(T.normalize_entity_types(types, ["Person", "Place"]), ",").alias("types"))


@query("tx6_keywords", "WITH k AS (SELECT doc_id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS w FROM documents), b AS (SELECT DISTINCT doc_id, regexp_replace(w, '^[.,?!:;\"''()\\[\\]{}]+|[.,?!:;\"''()\\[\\]{}]+$', '', 'g') AS kw FROM k) SELECT doc_id, kw FROM b WHERE length(kw) >= 2")
def _(spark, d):
    return documents.search_keys(S.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode("keywords").alias("kw"))


@query("j9_accent_free", f"WITH {S.CHUNKS}, n AS (SELECT document_id, chunk_index, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(content, 'ß', ' '))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM chunks) SELECT a.document_id, a.chunk_index AS needle, CAST(min(b.chunk_index) AS INT) AS block_no, 1000 AS score FROM n AS a JOIN n AS b ON a.document_id = b.document_id AND contains(b.t, a.t) WHERE a.t <> '' GROUP BY a.document_id, a.chunk_index")
def _(spark, d):
    """Each line, in capitals and without its accents, in its document."""
    c = S.chunks(spark, d)
    needles = c.select(F.struct("document_id", "chunk_index").alias("needle_id"), "document_id", F.upper(T.match_form("content")).alias("needle"))
    found = documents.locate_passage(needles, c.withColumnRenamed("chunk_index", "block_no"))
    return found.select("needle_id.document_id", F.col("needle_id.chunk_index").alias("needle"), "block_no", "score")
