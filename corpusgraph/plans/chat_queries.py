"""Registered queries over chat logs, event logs, evaluation rows and splitting, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import chat as C
from corpusgraph.operators import chunking as K
from corpusgraph.streaming import events as E

from . import standins as S

Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("t6_chat_history", "SELECT conv_id, turn, role FROM conversations")
def _(spark, d):
    return S.messages(spark, d).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("tx2_clean_answers", "SELECT conv_id, turn, trim(text) AS clean FROM conversations")
def _(spark, d):
    m = S.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("<think>why\nnot</think> "), "text", F.lit("<unused12>: ")).alias("content"))
    return C.clean_answers(m).select("conv_id", "turn", T.strip("clean").alias("clean"))


@query("s10_strip_citations", f"WITH {S.MESSAGES} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(content, '\\s*\\[(?:[a-z0-9]+|IMG-[a-z0-9]+)(?:,\\s*(?:[a-z0-9]+|IMG-[a-z0-9]+))*\\]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS bare FROM messages")
def _(spark, d):
    return S.messages(spark, d).select("conv_id", "turn", T.strip_citations("content").alias("bare"))


@query("w3_history_window", f"WITH {S.MESSAGES} SELECT conv_id, turn, coalesce(string_agg(left(content, 20), '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS recent FROM messages")
def _(spark, d):
    h = C.history_window(S.messages(spark, d), 3)
    return h.select("conv_id", "turn", F.array_join(F.transform("history", lambda m: F.substring(m["content"], 1, 20)), "|").alias("recent"))


@query("w4_qa_pairs", f"WITH {S.MESSAGES}, p AS (SELECT *, lag(role) OVER w AS before, lag(content) OVER w AS question FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, question, content AS answer FROM p WHERE role = 'assistant' AND before = 'user'")
def _(spark, d):
    return C.qa_pairs(S.messages(spark, d))


USAGE = f"""{S.MESSAGES}, ex AS (SELECT conv_id, turn, string_split(regexp_replace(array_to_string(regexp_extract_all(content, '\\[(?:[a-z0-9]+|IMG-[a-z0-9]+)(?:,\\s*(?:[a-z0-9]+|IMG-[a-z0-9]+))*\\]'), ','), '[\\[\\]\\s]', '', 'g'), ',') AS ids FROM messages WHERE role = 'assistant'),
usage AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS place, ids[i] AS cited FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM ex WHERE ids <> ['']))"""


@query("s9_tx7_citation_usage", f"WITH {USAGE} SELECT * FROM usage")
def _(spark, d):
    return C.citation_usage(S.messages(spark, d))


@query("w9_first_seen", f"WITH {USAGE} SELECT conv_id, cited, min({{'t': turn, 'p': place}}).t AS turn, min({{'t': turn, 'p': place}}).p AS place FROM usage GROUP BY conv_id, cited")
def _(spark, d):
    return C.first_seen(C.citation_usage(S.messages(spark, d)))


@query("j7_resolve_citations", f"WITH {USAGE}, src AS (SELECT conv_id, turn, cited, 'src-' || turn || '-' || cited AS source FROM usage WHERE turn % 4 = 1 OR conv_id % 3 = 0) SELECT u.conv_id, u.turn, u.place, u.cited, coalesce(own.source, (SELECT arg_min(s.source, s.turn) FROM src AS s WHERE s.conv_id = u.conv_id AND s.cited = u.cited AND s.turn < u.turn)) AS source FROM usage AS u LEFT JOIN src AS own ON own.conv_id = u.conv_id AND own.turn = u.turn AND own.cited = u.cited")
def _(spark, d):
    u = C.citation_usage(S.messages(spark, d))
    src = u.filter("turn % 4 = 1 or conv_id % 3 = 0").select("conv_id", "turn", "cited", F.format_string("src-%d-%s", "turn", "cited").alias("source"))
    return C.resolve_citations(u, src)


@query("tx7_uncited_sources", f"WITH {USAGE} SELECT conv_id, turn, cited || 'x' AS cited FROM usage GROUP BY ALL")
def _(spark, d):
    u = C.citation_usage(S.messages(spark, d))
    src = u.select("conv_id", "turn", "cited").distinct().select("conv_id", "turn", F.explode(F.array("cited", F.concat("cited", F.lit("x")))).alias("cited"))
    return C.uncited_sources(u, src)


@query("j7_resolve_images", "SELECT conv_id, turn, CAST(turn % 3 AS INT) AS place, CASE turn % 3 WHEN 0 THEN 'IMG-a' || conv_id WHEN 1 THEN 'IMG-2' ELSE 'IMG-zz' END AS cited, CASE turn % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS image FROM conversations")
def _(spark, d):
    m = S.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).cast("int").alias("place"))
    cited = F.when(F.col("place") == 0, F.concat(F.lit("IMG-a"), F.col("conv_id").cast("string"))).when(F.col("place") == 1, "IMG-2").otherwise("IMG-zz")
    shown = F.array(F.struct(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("ref_id"), F.lit("first").alias("image")), F.struct(F.lit("b").alias("ref_id"), F.lit("second").alias("image")))
    images = m.select("conv_id", "turn", F.posexplode(shown).alias("place", "x")).select("conv_id", "turn", "place", "x.*")
    return C.resolve_images(m.withColumn("cited", cited), images)


@query("a15_synth_distribution", "SELECT source AS synthesizer, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return C.synth_distribution(S.table(spark, d, "documents").withColumnRenamed("source", "synthesizer"))


@query("a19_source_badges", f"WITH {USAGE} SELECT conv_id, turn, count(DISTINCT cited) AS n FROM usage WHERE place < 3 GROUP BY conv_id, turn")
def _(spark, d):
    m = S.messages(spark, d).filter("role = 'assistant'").withColumn("ids", T.extract_citations("content"))
    return m.select("conv_id", "turn", F.size(C.source_badges("ids", 3)).cast("bigint").alias("n")).filter("n > 0")


@query("a17_rating_counts", "SELECT CASE toxic WHEN 1 THEN 'not_relevant' ELSE CASE quality WHEN 1 THEN 'relevant' ELSE 'partial' END END AS rating, count(*) AS n FROM labels GROUP BY 1")
def _(spark, d):
    value = F.when(F.col("toxic") == 1, "not_relevant").when(F.col("quality") == 1, "relevant").otherwise("partial")
    r = S.table(spark, d, "labels").select(T.set_rating(F.create_map(F.lit("1"), F.lit("partial")), F.lit("1"), value).alias("ratings"))
    return C.rating_counts(r)


@query("w5_sample_batches", f"WITH {S.CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS spot, count(*) OVER (PARTITION BY document_id) AS n FROM chunks), b AS (SELECT *, unnest(range(1, 4)) AS batch FROM p), x AS (SELECT *, ((spot - (batch - 1) * 5) % n + n) % n AS place FROM b) SELECT CAST(batch AS INT) AS batch, CAST(place AS INT) AS place, document_id, chunk_index, left(content, 800) AS content FROM x WHERE place < least(8, n)")
def _(spark, d):
    return C.sample_batches(S.chunks(spark, d), 3)


# Events as a log: users are sessions (or documents); signups roll back, purchases complete, the others bring tokens.
def log(spark, d):
    kind = F.when(F.col("event_type") == "signup", "token_rollback").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "status").otherwise("token")
    return S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "ts", kind.alias("event"), F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")).alias("data"))


LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'token_rollback' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'status' ELSE 'token' END AS event, 't' || (event_id % 7) AS data FROM events)"
ANSWERS = f"{LOG}, r AS (SELECT session, max(seq) AS last FROM log WHERE event = 'token_rollback' GROUP BY session), answers AS (SELECT log.session, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE event = 'token' AND seq > coalesce(last, -1)), '') AS answer, max(event = 'complete') AS done FROM log LEFT JOIN r USING (session) GROUP BY log.session)"


@query("st1_assemble_answers", f"WITH {ANSWERS} SELECT session, answer, done FROM answers")
def _(spark, d):
    return C.assemble_answers(log(spark, d))


@query("st1_assemble_answers_stream", f"WITH {ANSWERS} SELECT session, answer, done FROM answers")
def _(spark, d):
    return E.run_to_table(spark, E.assemble_answers_stream(E.replay(log(spark, d))), ["session"], "version").select("session", "answer", "done")


@query("st2_agent_timeline", f"WITH {LOG}, s AS (SELECT * FROM log WHERE event IN ('status', 'complete')) SELECT session, CAST(row_number() OVER w AS INT) AS step, CASE event WHEN 'complete' THEN 'done' ELSE data END AS name, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS duration FROM s WINDOW w AS (PARTITION BY session ORDER BY seq)")
def _(spark, d):
    return C.agent_timeline(log(spark, d)).select("session", "step", "name", "duration")


def agent_log(spark, d):
    """Events of agents: kind and content follow from event_id."""
    i = F.col("event_id")
    kind = F.pmod(i * 7 + F.floor(i / 11), F.lit(10))
    names = F.element_at(F.array(*map(F.lit, ("analyzing", "retrieving", "generating", "other"))), (kind + 1).cast("int"))
    event = F.when(kind < 4, "status").when(kind == 4, "sources").when(kind == 5, "images").when(kind == 6, "thinking").when(kind == 7, "complete").when(kind == 8, "error").otherwise("token")
    ids = F.concat_ws("|", F.concat(F.lit("s"), (i % 5).cast("string")), F.when(i % 3 > 0, F.concat(F.lit("s"), (i % 4).cast("string"))))
    data = F.when(kind < 4, names).when(kind == 4, ids).when(kind == 5, F.when(i % 2 == 0, ids).otherwise("")).otherwise(F.concat(F.lit("t"), (i % 7).cast("string")))
    return S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), i.alias("seq"), event.alias("event"), data.alias("data"), "ts")


@query("st2_agent_steps", None)
def _(spark, d):
    return C.agent_timeline(agent_log(spark, d))


@query("st2b_client_timeline", None)
def _(spark, d):
    return C.client_timeline(agent_log(spark, d))


STATUS = "st AS (SELECT user_id AS document_id, event_id AS seq, ts, ['PARSING', 'PROCESSING', 'INDEXING', 'INDEXED', 'FAILED'][CAST(event_id % 5 + 1 AS INT)] AS status FROM events)"


def status_log(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), "ts", F.element_at(F.array(*map(F.lit, ("PARSING", "PROCESSING", "INDEXING", "INDEXED", "FAILED"))), (F.col("event_id") % 5 + 1).cast("int")).alias("status"))


@query("st3_document_status", f"WITH {STATUS} SELECT document_id, arg_max(status, {{'ts': ts, 'seq': seq}}) AS status, max(epoch_us(ts)) FILTER (WHERE status = 'INDEXED') - min(epoch_us(ts)) FILTER (WHERE status = 'PARSING') AS elapsed_us FROM st GROUP BY document_id")
def _(spark, d):
    return C.document_status(status_log(spark, d)).drop("error")


@query("st3_document_status_stream", f"WITH {STATUS} SELECT document_id, arg_max(status, {{'ts': ts, 'seq': seq}}) AS status FROM st GROUP BY document_id")
def _(spark, d):
    return E.run_to_table(spark, E.document_status_stream(E.replay(status_log(spark, d))), ["document_id"], "seq").select("document_id", "status")


@query("st8_decode_sse", "SELECT session, seq * 4 + 2 AS seq, 'e' || (seq % 3) AS event, '{\"k\": ' || seq || '}' AS data FROM (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq FROM events)")
def _(spark, d):
    s = F.col("seq").cast("string")
    lines = F.array(F.concat(F.lit("event: e"), (F.col("seq") % 3).cast("string")), F.lit(": heartbeat"), F.concat(F.lit('data: {"k": '), s, F.lit("}")), F.lit("data: {broken"))
    return C.decode_sse(log(spark, d).select("session", "seq", F.posexplode(lines).alias("i", "line")).select("session", (F.col("seq") * 4 + F.col("i")).alias("seq"), "line"))


# Evaluation rows: each labelled document is an answer.
def answers(spark, d):
    docs = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    cite = F.when(F.col("doc_id") % 4 == 0, " [1]").when(F.col("doc_id") % 4 == 1, " not contain [2]. [1, 2]").when(F.col("doc_id") % 4 == 2, " <unused7>:").otherwise(" no information")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat("text", cite).alias("answer"), F.array(F.lit("the"), F.lit("zzz"), F.lit("An")).alias("expected_keywords"),
        (F.col("toxic") == 1).alias("expected_refuse"), F.when(F.col("doc_id") % 5 == 0, "vi").otherwise("en").alias("language"), (F.col("doc_id") % 4).cast("int").alias("source_count"),
        F.col("source").alias("category"), (F.col("doc_id") % 100).cast("double").alias("latency_ms"),
    )


_ANSWER = "text || CASE doc_id % 4 WHEN 0 THEN ' [1]' WHEN 1 THEN ' not contain [2]. [1, 2]' WHEN 2 THEN ' <unused7>:' ELSE ' no information' END"
EVAL = f"""a AS (SELECT doc_id AS id, {_ANSWER} AS answer, toxic = 1 AS refuse, CASE WHEN doc_id % 5 = 0 THEN 'vi' ELSE 'en' END AS language, doc_id % 4 AS n, source AS category, CAST(doc_id % 100 AS DOUBLE) AS latency FROM documents JOIN labels USING (doc_id)),
w AS (SELECT *, len(list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> '')) AS words, lower(answer) AS low FROM a),
f AS (SELECT *, contains(low, 'not contain') AS ref, contains(low, 'not contain') OR contains(low, 'no information') AS pha, regexp_matches(answer, '\\[(?:IMG-)?\\d+\\]') AS cit, len(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))) AS cited,
  length(regexp_replace(low, '[^áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ]', '', 'g')) AS vi, length(regexp_replace(answer, '[^\\p{{L}}]', '', 'g')) AS alpha FROM w),
m AS (SELECT *, (contains(low, 'the')::INT + contains(low, 'zzz')::INT + contains(low, 'an')::INT) / 3 AS m1,
  CASE WHEN refuse THEN ref::INT WHEN ref AND words < 20 THEN 0 WHEN ref THEN 0.8 ELSE 1 END::DOUBLE AS m2,
  CASE WHEN pha AND words < 20 AND cit THEN 0 WHEN len(list_filter(string_split_regex(answer, '[.!?\\n]'), lambda s: (contains(lower(s), 'not contain') OR contains(lower(s), 'no information')) AND regexp_matches(s, '\\[(?:IMG-)?\\d+\\]'))) > 0 THEN 0.3 ELSE 1 END::DOUBLE AS m3,
  CASE WHEN regexp_matches(answer, '\\[\\d+[,\\s]+\\d+\\]') THEN 0 ELSE 1 END::DOUBLE AS m4, CASE WHEN regexp_matches(answer, '<unused\\d+>') THEN 0 ELSE 1 END::DOUBLE AS m5,
  CASE WHEN language <> 'vi' OR alpha = 0 OR vi / alpha > 0.03 THEN 1 ELSE 0 END::DOUBLE AS m6, CASE WHEN refuse THEN 1 WHEN words < 10 THEN 0.2 WHEN words < 30 THEN 0.6 ELSE 1 END::DOUBLE AS m7,
  CASE WHEN refuse OR n = 0 THEN 1 ELSE least(cited / greatest(n, 1), 1) END::DOUBLE AS m8 FROM f),
ev AS (SELECT *, (m1 + m2 + m3 + m4 + m5 + m6 + m7 + m8) / 8 AS overall FROM m)"""


@query("m_all_metrics", f"WITH {EVAL} SELECT id, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, m4, m5, m6, m7, round(m8, 6) AS m8, round(overall, 6) AS overall FROM ev")
def _(spark, d):
    e = C.evaluate(answers(spark, d))
    return e.select("id", *[F.round(F.col("metrics")[i]["score"], 6).alias(f"m{i + 1}") for i in range(8)], F.round("overall_score", 6).alias("overall"))


@query("m15_test_status", f"WITH {EVAL} SELECT id, CASE WHEN overall >= 0.7 THEN 'PASS' WHEN overall >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM ev")
def _(spark, d):
    return C.evaluate(answers(spark, d)).select("id", "status")


@query("a11_eval_by_category", f"WITH {EVAL} SELECT category, count(*) AS tests, count(*) FILTER (WHERE overall >= 0.7) AS passed, round(avg(overall), 6) AS avg_score, avg(latency) AS avg_latency FROM ev GROUP BY category")
def _(spark, d):
    return C.eval_by_category(C.evaluate(answers(spark, d))).withColumn("avg_score", F.round("avg_score", 6))


@query("a12_eval_by_metric", f"WITH {EVAL} SELECT 'keyword_coverage' AS name, round(avg(m1), 6) AS avg_score, round(avg((m1 >= 0.5)::INT), 6) AS pass_rate, count(*) AS n FROM ev UNION ALL SELECT 'refusal_accuracy', round(avg(m2), 6), round(avg((m2 > 0)::INT), 6), count(*) FROM ev UNION ALL SELECT 'no_phantom_citations', round(avg(m3), 6), round(avg((m3 = 1)::INT), 6), count(*) FROM ev UNION ALL SELECT 'citation_format', round(avg(m4), 6), round(avg(m4), 6), count(*) FROM ev UNION ALL SELECT 'no_token_artifacts', round(avg(m5), 6), round(avg(m5), 6), count(*) FROM ev UNION ALL SELECT 'language_match', round(avg(m6), 6), round(avg(m6), 6), count(*) FROM ev UNION ALL SELECT 'answer_completeness', round(avg(m7), 6), round(avg((m7 > 0.2)::INT), 6), count(*) FROM ev UNION ALL SELECT 'context_utilization', round(avg(m8), 6), round(avg((m8 >= 0.2)::INT), 6), count(*) FROM ev")
def _(spark, d):
    return C.eval_by_metric(C.evaluate(answers(spark, d))).withColumns({c: F.round(c, 6) for c in ("avg_score", "pass_rate")})


@query("a13_eval_overall", f"WITH {EVAL} SELECT round(avg(overall), 6) AS overall, count(*) FILTER (WHERE overall >= 0.7) AS passed, count(*) AS tests, avg(latency) AS avg_latency, CASE WHEN avg(overall) >= 0.85 THEN 'EXCELLENT' WHEN avg(overall) >= 0.7 THEN 'GOOD' WHEN avg(overall) >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS verdict FROM ev")
def _(spark, d):
    return C.eval_overall(C.evaluate(answers(spark, d))).withColumn("overall", F.round("overall", 6))


@query("a14_synth_eval", "WITH r AS (SELECT source, doc_id % 10 / 10 AS substance, doc_id % 4 / 4 AS utilization FROM documents) SELECT 'synthesizer' AS kind, source AS name, round(avg((substance + utilization) / 2), 6) AS avg_score, NULL::DOUBLE AS pass_rate, count(*) AS n FROM r GROUP BY source UNION ALL SELECT 'metric', 'substance', round(avg(substance), 6), round(avg((substance >= 0.5)::INT), 6), NULL FROM r UNION ALL SELECT 'metric', 'utilization', round(avg(utilization), 6), round(avg((utilization >= 0.5)::INT), 6), NULL FROM r")
def _(spark, d):
    i = F.col("doc_id")
    r = S.table(spark, d, "documents").select(i.alias("id"), F.col("source").alias("synthesizer"), F.create_map(F.lit("substance"), i % 10 / 10, F.lit("utilization"), i % 4 / 4).alias("metrics"))
    by_metric, by_synthesizer = C.synth_eval_summary(r)
    both = by_metric.withColumn("kind", F.lit("metric")).unionByName(by_synthesizer.withColumnRenamed("synthesizer", "name").withColumn("kind", F.lit("synthesizer")), allowMissingColumns=True)
    return both.withColumns({c: F.round(c, 6) for c in ("avg_score", "pass_rate")})


@query("m14_parse_question_batches", "SELECT item_id AS batch, 0 AS place, 'Q' || item_id AS question, text AS answer FROM benchmark")
def _(spark, d):
    rows = F.to_json(F.array(F.struct(F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("answer"), F.array(F.lit(0)).alias("context_indices"))))
    b = S.table(spark, d, "benchmark").select(F.col("item_id").alias("batch"), F.concat(F.lit("```json\n"), rows, F.lit("\n```")).alias("output"))
    return C.parse_question_batches(b).select("batch", "place", "question", "answer")


@query("m13_attach_scores", "WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 6 <> 0) SELECT doc_id AS id, CASE WHEN n % 4 <> 0 THEN n / 10 END AS score FROM documents LEFT JOIN r ON r.id = doc_id")
def _(spark, d):
    r = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, "ERROR: x").otherwise("fine").alias("response"))
    n = r.count() - r.filter("id % 6 = 0").count()
    scores = spark.range(1, n + 1).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("id") / 10).alias("score"))
    return C.attach_scores(r, scores).select("id", "score")


# Splitting: documents' lines become Markdown by their number.
def markdown(spark, d):
    mark = lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("# H"), i.cast("string"))).when(i % 6 == 2, F.concat(F.lit("## S"), i.cast("string"))).when(i % 6 == 4, "|a|b|\n|---|---|\n|1|2|").otherwise(x)
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


def _sentences(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _windows(text: str, limit: int) -> str:
    """Sentences of a text in windows of at most `limit` characters, as list_reduce over lists of one sentence."""
    grown = f"CASE WHEN len(done) = 0 THEN s WHEN length(done[-1]) + length(s[1]) + 1 <= {limit} THEN list_concat(done[1:len(done) - 1], [done[-1] || ' ' || s[1]]) ELSE list_concat(done, s) END"
    return f"list_filter(list_reduce(list_transform({_sentences(text)}, lambda x: [x]), lambda done, s: {grown}, CAST([] AS VARCHAR[])), lambda x: trim(x) <> '')"


def _packed(text: str, limit: int) -> str:
    """Paragraphs of a text in pieces, as list_reduce over lists of one unit; the last unit of the list is the open piece."""
    unit = lambda x, glue, opens: f"{{'text': {x}, 'glue': {glue}, 'opens': {opens}}}"
    cut = f"list_transform({_sentences('p')}, lambda x, i: [{unit('x', repr(' '), 'i = 1')}])"
    units = f"flatten(list_transform(string_split_regex({text}, '\\n\\s*\\n'), lambda p: CASE WHEN length(p) > {limit} THEN {cut} ELSE [[{unit('p', 'chr(10) || chr(10)', 'false')}]] END))"
    joined = unit("CASE WHEN done[-1].text = '' THEN u[1].text ELSE done[-1].text || u[1].glue || u[1].text END", "''", "false")
    step = f"CASE WHEN len(done) = 0 THEN u WHEN u[1].opens OR length(done[-1].text) + length(u[1].text) + length(u[1].glue) > {limit} THEN list_concat(done, u) ELSE list_concat(done[1:len(done) - 1], [{joined}]) END"
    none = "CAST([] AS STRUCT(text VARCHAR, glue VARCHAR, opens BOOLEAN)[])"
    pieces = f"list_filter(list_transform(list_reduce({units}, lambda done, u: {step}, {none}), lambda x: {_strip('x.text')}), lambda x: x <> '')"
    return f"CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE {pieces} END"


def _markdown_of(html: str) -> str:
    t = html
    for tag in ("script", "style", "nav", "footer", "head"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    for k in range(1, 7):
        t = f"regexp_replace({t}, '(?is)<h{k}\\b[^>]*>(.*?)</h{k}>', chr(10) || '{'#' * k} \\1' || chr(10), 'g')"
    t = f"regexp_replace({t}, '(?is)<li\\b[^>]*>', chr(10) || '- ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?is)</?(p|div|br|ul|ol|tr|table|section|article)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{entity}', {char})"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return _strip(f"regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g')")


MD = f"{S.CHUNKS}, md AS (SELECT document_id, chunk_index AS i, CASE chunk_index % 6 WHEN 0 THEN '# H' || chunk_index WHEN 2 THEN '## S' || chunk_index WHEN 4 THEN '|a|b|' ELSE content END AS line FROM chunks)"


@query("c9_outline", f"WITH {MD} SELECT document_id, CASE WHEN i % 6 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN i % 6 = 0 THEN 'H' ELSE 'S' END || i AS title FROM md WHERE i % 6 IN (0, 2)")
def _(spark, d):
    return K.outline(markdown(spark, d)).select("document_id", "level", "title")


@query("c7_extract_tables", f"WITH {MD} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INT) AS table_no, 1 AS num_rows, 2 AS num_cols FROM md WHERE i % 6 = 4")
def _(spark, d):
    return K.extract_tables(markdown(spark, d)).select("document_id", "table_no", "num_rows", "num_cols")


SECTIONS = f"""{MD}, s AS (SELECT document_id, i, line, i // 6 * 6 AS h, CASE WHEN i % 6 >= 2 THEN i // 6 * 6 + 2 END AS sub FROM md WHERE i % 6 NOT IN (0, 2)),
sections AS (SELECT document_id, h, sub, 'H' || h || CASE WHEN sub IS NULL THEN '' ELSE ' > S' || sub END AS path, {_strip("string_agg(CASE WHEN i % 6 = 4 THEN '|a|b|' || chr(10) || '|---|---|' || chr(10) || '|1|2|' ELSE line END, chr(10) ORDER BY i)")} AS content FROM s GROUP BY document_id, h, sub HAVING content <> '')"""


@query("c2_split_sections", f"WITH {SECTIONS} SELECT document_id, path, content FROM sections")
def _(spark, d):
    return K.split_sections(markdown(spark, d)).select("document_id", F.array_join("heading_path", " > ").alias("path"), "content")


@query("c4_chunk_markdown", f"WITH {SECTIONS}, p AS (SELECT document_id, h, coalesce(sub, h) AS spot, path, {_packed('content', 256)} AS pieces FROM sections), u AS (SELECT document_id, spot, path, i, pieces[i] AS content FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM p)) SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY spot, i) - 1 AS INT) AS chunk_index, content, path, contains(content, '|') AND contains(content, '---') AS has_table, contains(content, '```') AS has_code, path || ': ' || left(content, 100) AS contextualized FROM u")
def _(spark, d):
    return K.chunk_markdown(markdown(spark, d), 64).withColumn("path", F.array_join("heading_path", " > ")).drop("heading_path", "page_no", "image_refs", "table_refs")


@query("c1_chunk_recursive", None)
def _(spark, d):
    return K.chunk_recursive(S.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("c5_sentence_windows", f"WITH w AS (SELECT doc_id, {_windows('text', 900)} AS w FROM documents) SELECT doc_id, CAST(i - 1 AS INT) AS window, w[i] AS content FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.posexplode(K.sentence_windows(F.col("text"))).alias("window", "content"))


@query("c10_html_to_markdown", f"SELECT page_id, {_markdown_of('html')} AS markdown FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", K.html_to_markdown(F.col("html")).alias("markdown"))


@query("st5_ingest_stream", f"WITH {S.DOCS} SELECT id AS document_id, chunk_count AS n FROM docs")
def _(spark, d):
    return E.ingest_lines(spark, d)


@query("x4_build_turns", f"WITH {S.MESSAGES}, h AS (SELECT *, string_agg(role || ': ' || left(content, 300), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM messages) SELECT conv_id, turn, CASE WHEN before IS NULL THEN '' ELSE 'Earlier:' || chr(10) || before || chr(10) || chr(10) END || 'Question: ' || content AS prompt FROM h WHERE role = 'user'")
def _(spark, d):
    return C.build_turns(S.messages(spark, d))


@query("p9_clear_history", f"WITH {S.MESSAGES} SELECT conv_id, turn FROM messages WHERE conv_id % 3 <> 0")
def _(spark, d):
    m = S.messages(spark, d)
    return C.clear_history(C.append_messages(m.filter("turn = 0"), m.filter("turn > 0")), m.filter("conv_id % 3 = 0")).select("conv_id", "turn")


@query("m10_m11_substance", f"WITH {EVAL} SELECT id, round(least(words / 10, 1), 6) AS substance, CASE WHEN n = 0 THEN 1 WHEN cited > 0 THEN round(least(greatest(cited / n, cited / 3), 1), 6) ELSE 0 END::DOUBLE AS utilization FROM ev")
def _(spark, d):
    from corpusgraph.functions import metrics as M

    return answers(spark, d).select("id", F.round(M.answer_substance("answer"), 6).alias("substance"), F.round(M.context_utilization_v2("answer", "source_count"), 6).alias("utilization"))


@query("m12_resolve_contexts", f"WITH {S.CHUNKS}, i AS (SELECT row_number() OVER (ORDER BY item_id) AS n, item_id, text FROM benchmark) SELECT 'RAGAS-' || CASE WHEN n < 1000 THEN right('000' || n, 3) ELSE n::VARCHAR END AS id, text AS answer, left(content, 500) AS context FROM i JOIN chunks ON document_id = item_id AND chunk_index = 0")
def _(spark, d):
    b = S.table(spark, d, "benchmark").select(F.col("item_id").alias("batch"), F.lit(0).alias("place"), F.lit("q").alias("question"), F.col("text").alias("answer"), F.array(F.lit(0), F.lit(99_999)).alias("context_indices"))
    c = S.chunks(spark, d).select(F.col("document_id").alias("batch"), F.col("chunk_index").alias("place"), "content")
    return C.resolve_contexts(b, c).select("id", "answer", F.explode("contexts").alias("context"))


@query("c8_table_captions", f"WITH {MD}, l AS (SELECT document_id, i, CASE WHEN i % 6 = 4 THEN '|a|b|' || chr(10) || '|---|---|' || chr(10) || '|1|2|' || CASE WHEN document_id % 2 = 0 THEN chr(10) || chr(10) || '*Letters*' ELSE '' END ELSE line END AS line FROM md) SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY document_id")
def _(spark, d):
    m = markdown(spark, d)
    return K.inject_table_captions(m, m.filter("document_id % 2 = 0").select("document_id", F.lit("a|b").alias("key"), F.lit("Letters").alias("caption")))


@query("c6_split_for_embedding", f"WITH w AS (SELECT doc_id, {_windows('text', 1600)} AS w FROM documents), p AS (SELECT doc_id, flatten(list_transform(w, lambda s: CASE WHEN length(s) > 1600 THEN list_transform(range(0, length(s) - 200, 1400), lambda i: substring(s, i + 1, 1600)) ELSE [s] END)) AS p FROM w) SELECT doc_id, CAST(i - 1 AS INT) AS part, p[i] AS input FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p)")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.posexplode(K.split_for_embedding(F.col("text"))).alias("part", "input"))


@query("c3_pack_paragraphs", f"WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), p AS (SELECT doc_id, {_packed('text', 512)} AS p FROM t) SELECT doc_id, CAST(i - 1 AS INT) AS piece, p[i] AS content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p)")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.posexplode(K.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 128)).alias("piece", "content"))
