"""Chat logs and evaluation: history, citations, ratings, event logs, score summaries.

Unless a function says otherwise: a null id is a group of its own where rows are grouped and meets nothing where they are joined, a
null text gives null (and is no text where texts are looked into), equal rows count each, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import metrics as M
from corpusgraph.functions import text as T
from corpusgraph.sources.shared import write_table


def clean_answers(messages: DataFrame) -> DataFrame:
    """Messages with tool_call (name and arguments of a call in the text, else null), clean (no reasoning, calls, artifacts) and plain (no citations, no Markdown)."""
    df = messages.withColumn("_call", T.extract_tool_call(T.strip_reasoning("content", F.lit(None).cast("string"))))
    call = F.when(F.col("_call.name").isNotNull(), F.struct("_call.name", "_call.arguments"))
    return df.withColumns({"tool_call": call, "clean": T.strip_artifacts(F.col("_call.rest"))}).drop("_call").withColumn("plain", T.markdown_to_text("clean"))


def history_window(messages: DataFrame, n: int = 10) -> DataFrame:
    """Each message with the n before it, as array<struct<role, content>>; messages of one turn stand by role, then content, null turns first."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(-n, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "content")).over(w))


def recap(history: Column, n: int = 2, cut: int = 300) -> Column:
    """The last n messages of a history, cut short."""
    last = F.slice(history, F.greatest(F.size(history) - (n - 1), F.lit(1)), F.lit(n))
    return F.array_join(F.transform(last, lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["content"], 1, cut))), "\n")


def qa_pairs(messages: DataFrame) -> DataFrame:
    """Each answer with the user message right before it; messages of one turn stand as in history_window."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    df = messages.withColumns({"before": F.lag("role").over(w), "question": F.lag("content").over(w)})
    return df.filter("role = 'assistant' and before = 'user'").select("conv_id", "turn", "question", F.col("content").alias("answer"))


def citation_usage(messages: DataFrame) -> DataFrame:
    """A row for each id cited by an answer: conv_id, turn, place, cited."""
    return messages.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.extract_citations("content")).alias("place", "cited"))


def first_seen(usage: DataFrame) -> DataFrame:
    """Where in a conversation an id is first cited."""
    return usage.groupBy("conv_id", "cited").agg(F.min(F.struct("turn", "place")).alias("at")).select("conv_id", "cited", F.col("at.turn").alias("turn"), F.col("at.place").alias("place"))


def resolve_citations(usage: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited ids with the source (conv_id, turn, cited, source) of their own message, else of the earliest message before it that has one."""
    own = sources.select("conv_id", "turn", "cited", F.col("source").alias("own"))
    met = usage.join(own, ["conv_id", "turn", "cited"], "left")
    old = sources.select("conv_id", "cited", F.struct("turn", "source").alias("s"))
    before = usage.join(old, ["conv_id", "cited"]).filter(F.col("s.turn") < F.col("turn")).groupBy("conv_id", "turn", "place", "cited").agg(F.min("s").alias("s"))
    met = met.join(before, ["conv_id", "turn", "place", "cited"], "left")
    return met.select("conv_id", "turn", "place", "cited", F.coalesce("own", F.col("s.source")).alias("source"))


def uncited_sources(usage: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (conv_id, turn, cited, source) that their own message does not cite."""
    return sources.join(usage.select("conv_id", "turn", "cited").distinct(), ["conv_id", "turn", "cited"], "left_anti")


def resolve_images(usage: DataFrame, images: DataFrame) -> DataFrame:
    """conv_id, turn, place, cited, image: cited IMG-x with the message's image whose ref_id is x, else the x-th one if x begins with a number.

    images are (conv_id, turn, place from 0, ref_id, image); of one ref_id the first counts. Ids of no image get null.
    """
    ref = F.regexp_extract("cited", "^IMG-(.+)$", 1)
    asked = usage.filter(F.startswith("cited", F.lit("IMG-"))).withColumns({"ref": ref, "nth": F.regexp_extract(ref, r"^([0-9]+)", 1).try_cast("long") - 1})
    named = images.groupBy("conv_id", "turn", F.col("ref_id").alias("ref")).agg(F.min_by("image", "place").alias("by_ref"))
    placed = images.select("conv_id", "turn", F.col("place").cast("long").alias("nth"), F.col("image").alias("by_place"))
    met = asked.join(named, ["conv_id", "turn", "ref"], "left").join(placed, ["conv_id", "turn", "nth"], "left")
    return met.select("conv_id", "turn", "place", "cited", F.coalesce("by_ref", "by_place").alias("image"))


def rating_counts(ratings: DataFrame) -> DataFrame:
    """Tally of the values of rating maps."""
    return ratings.select(F.explode("ratings").alias("key", "rating")).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def source_badges(c: str, most: int = 6) -> Column:
    return F.array_distinct(F.slice(F.col(c), 1, most))


def sample_batches(chunks: DataFrame, batches: int, size: int = 8, step: int = 5, cut: int = 800) -> DataFrame:
    """batch, place, document_id, chunk_index, content: windows of a document's chunks that start `step` apart and wrap around."""
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    placed = chunks.withColumns({"at": at, "n": F.count(F.lit(1)).over(Window.partitionBy("document_id"))})
    # a chunk stands in batch b at place (at - b * step) mod n if that is below size
    each = placed.withColumn("batch", F.explode(F.sequence(F.lit(1), F.lit(batches))))
    each = each.withColumn("place", F.pmod(F.col("at") - (F.col("batch") - 1) * step, F.col("n")).cast("int"))
    return each.filter(F.col("place") < F.least(F.lit(size), F.col("n"))).select("batch", "place", "document_id", "chunk_index", F.substring("content", 1, cut).alias("content"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# --- event logs ----------------------------------------------------------------------------------------------------------------


def assemble_answers(events: DataFrame) -> DataFrame:
    """session, answer, done of event rows (session, seq, event, data): tokens after the last rollback, joined."""
    w = Window.partitionBy("session")
    last = F.max(F.when(F.col("event") == "token_rollback", F.col("seq"))).over(w)
    df = events.withColumn("live", (F.col("event") == "token") & (F.col("seq") > F.coalesce(last, F.lit(-1))))
    tokens = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("seq", "data")))), lambda x: x["data"]), "")
    return df.groupBy("session").agg(tokens.alias("answer"), F.max(F.col("event") == "complete").alias("done"))


def _listed(c: str) -> Column:
    return F.coalesce(F.filter(T.decode_list(c), lambda x: x != ""), F.array().cast("array<string>"))


def _numbered_steps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("session").orderBy("seq", "part")))


def agent_timeline(events: DataFrame) -> DataFrame:
    """The steps stored with an answer: session, step, name, detail, n_sources, n_images, badges, thinking, duration.

    events are (session, seq, event, data, ts); data names the step of a status, the ids of sources or images (parted by |), the text
    of a thought. A status is a step. Sources that came since the last `generating` are a step sources_found before the next one, or
    before the end if there was none; its badges are the different ids among the first six. All thoughts after the first `analyzing`
    belong to it. The last step is done. duration runs to the next step, in microseconds; null data counts as empty.
    """
    order = Window.partitionBy("session").orderBy("seq")
    generating = (F.col("event") == "status") & (F.col("data") == "generating")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a part of a session ends with a `generating`; sources wait for the end of their part, images for the next part with sources
    parted = events.withColumn("at_part", F.coalesce(F.count_if(F.coalesce(generating, F.lit(False))).over(before), F.lit(0)))
    of = lambda kind: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("event") == kind, F.struct("seq", _listed("data").alias("ids"))))), lambda x: x["ids"]))
    held = parted.groupBy("session", "at_part").agg(of("sources").alias("sources"), F.size(of("images")).alias("images"))
    parts = Window.partitionBy("session").orderBy("at_part")
    found = F.size("sources") > 0
    held = held.withColumn("upto", F.sum("images").over(parts)).withColumn("spent", F.coalesce(F.last(F.when(found, F.col("upto")), ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("found_before", F.coalesce(F.max(found).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    held = held.select("session", "at_part", "sources", (F.col("upto") - F.col("spent")).alias("n_images"), "found_before")
    steps = parted.filter("event in ('status', 'complete')").join(held, ["session", "at_part"])
    done = F.col("event") == "complete"
    inserted = (F.size("sources") > 0) & ((generating & ~done) | (done & ~F.col("found_before")))
    own = F.struct(F.lit(1).alias("part"), F.when(done, "done").otherwise(F.coalesce("data", F.lit(""))).alias("name"), F.lit(None).cast("int").alias("n_sources"), F.lit(None).cast("long").alias("n_images"), F.lit(None).cast("array<string>").alias("badges"))
    extra = F.struct(F.lit(0).alias("part"), F.lit("sources_found").alias("name"), F.size("sources").alias("n_sources"), F.col("n_images").cast("long").alias("n_images"), F.array_distinct(F.slice("sources", 1, 6)).alias("badges"))
    rows = steps.select("session", "seq", "ts", F.explode(F.when(inserted, F.array(extra, own)).otherwise(F.array(own))).alias("s")).select("session", "seq", "ts", "s.*")
    rows = _numbered_steps(rows)
    line = Window.partitionBy("session").orderBy("step")
    rows = rows.withColumn("duration", _micros(F.lead("ts").over(line)) - _micros(F.col("ts")))
    first = rows.filter("name = 'analyzing'").groupBy("session").agg(F.min(F.struct("step", "seq")).alias("a"))
    thoughts = events.filter("event = 'thinking'").join(first, "session").filter(F.col("seq") > F.col("a.seq"))
    thoughts = thoughts.groupBy("session", F.col("a.step").alias("step")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("data", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("thinking"))
    detail = F.when(F.col("name") == "sources_found", F.concat(F.lit("Found "), F.col("n_sources").cast("string"), F.when(F.col("n_sources") == 1, " source").otherwise(" sources"))).when(F.col("name") == "done", "Done").otherwise("")
    return rows.join(thoughts, ["session", "step"], "left").select("session", "step", "name", detail.alias("detail"), "n_sources", "n_images", "badges", "thinking", "duration")


def client_timeline(events: DataFrame) -> DataFrame:
    """The steps shown while an answer is made, from the events of agent_timeline: session, step, name, status, duration, n_sources, n_images, badges, total.

    `retrieving` is two steps, understood and itself; other statuses than analyzing, retrieving and generating are none. Sources are a
    step at once, images are counted to the last one before them. Steps begun by a status stay active until the next retrieving,
    generating, sources or complete (completed, with duration) or error. total is the time from the first event to a done step. Times
    are microseconds. Sessions without such events have no rows.
    """
    order = Window.partitionBy("session").orderBy("seq")
    following = order.rowsBetween(1, Window.unboundedFollowing)
    status = lambda *names: F.coalesce((F.col("event") == "status") & F.col("data").isin(*names), F.lit(False))
    ends = status("retrieving", "generating") | F.col("event").isin("sources", "complete", "error")
    marked = events.withColumns({
        "over": F.first(F.when(ends, F.struct(_micros(F.col("ts")).alias("at"), (F.col("event") == "error").alias("bad"))), ignorenulls=True).over(following),
        "began": F.first(_micros(F.col("ts"))).over(order), "lot": F.count_if(F.col("event") == "sources").over(order),
    })
    images = marked.filter("event = 'images'").groupBy("session", "lot").agg(F.sum(F.size(_listed("data"))).alias("images"))
    rows = marked.filter(status("analyzing", "retrieving", "generating") | F.col("event").isin("sources", "complete"))
    finished = lambda part, name: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.lit(False).alias("waits"))
    waiting = F.array(F.struct(F.lit(1).alias("part"), F.col("data").alias("name"), F.lit(True).alias("waits")))
    made = F.when(F.col("event") == "sources", F.array(finished(1, "sources_found"))).when(F.col("event") == "complete", F.array(finished(1, "done")))
    made = made.when(status("retrieving"), F.concat(F.array(finished(0, "understood")), waiting)).otherwise(waiting)
    rows = _numbered_steps(rows.withColumn("m", F.explode(made)).select("*", "m.*")).join(images, ["session", "lot"], "left")
    at, sources = _micros(F.col("ts")), F.col("name") == "sources_found"
    state = F.when(~F.col("waits"), "completed").when(F.col("over").isNull(), "active").when(F.col("over.bad"), "error").otherwise("completed")
    lasted = F.when(F.col("waits") & ~F.col("over.bad"), F.col("over.at") - at)
    return rows.select(
        "session", "step", "name", state.alias("status"), lasted.alias("duration"), F.when(sources, F.size(_listed("data"))).alias("n_sources"),
        F.when(sources, F.coalesce("images", F.lit(0))).alias("n_images"), F.when(sources, _listed("data")).alias("badges"), F.when(F.col("name") == "done", at - F.col("began")).alias("total"),
    )


def status_columns(events: DataFrame) -> list[Column]:
    """Aggregates over a document's status events: status (the latest), seq, elapsed_us from the first PARSING to the last INDEXED, error.

    error is the first 500 characters of the latest event's error text (a column that events may lack), for documents that failed.
    """
    at = lambda s, f: f(F.when(F.col("status") == s, _micros(F.col("ts"))))
    said = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    last = F.max(F.struct("ts", "seq", "status", said.alias("error")))
    failed = F.when(last["status"] == "FAILED", F.substring(last["error"], 1, 500))
    return [last["status"].alias("status"), last["seq"].alias("seq"), (at("INDEXED", F.max) - at("PARSING", F.min)).alias("elapsed_us"), failed.alias("error")]


def document_status(events: DataFrame) -> DataFrame:
    """document_id and status_columns but seq; documents without events have no row."""
    return events.groupBy("document_id").agg(*status_columns(events)).drop("seq")


def decode_sse(lines: DataFrame) -> DataFrame:
    """session, seq, event, data of captured log lines (session, seq, line): an event name holds until the next; comments and data that is no JSON are left out."""
    w = Window.partitionBy("session").orderBy("seq")
    name = F.last(F.when(F.startswith("line", F.lit("event:")), F.trim(F.substring("line", 7, 1_000_000))), ignorenulls=True).over(w)
    data = F.when(F.startswith("line", F.lit("data:")), F.trim(F.substring("line", 6, 1_000_000_000)))
    df = lines.select("session", "seq", name.alias("event"), data.alias("data")).filter("data is not null")
    return df.filter(F.try_parse_json("data").isNotNull())


def numbered_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column of 1, 2, ... in order, by ranges: rows are counted a range, and each range starts where those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = write_table(ranged.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), "numbered")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    starts = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


# --- evaluation ----------------------------------------------------------------------------------------------------------------


def evaluate(answers: DataFrame) -> DataFrame:
    """answers (answer, expected_keywords, expected_refuse, language, source_count) with metrics, overall_score, status, failed."""
    m = M.all_metrics("answer", "expected_keywords", "expected_refuse", "language", "source_count")
    df = answers.withColumn("metrics", m).withColumn("overall_score", M.overall_score("metrics"))
    return df.withColumns({"status": M.test_status("overall_score"), "failed": F.transform(F.filter("metrics", lambda x: ~x["passed"]), lambda x: x["name"])})


def eval_by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("overall_score") >= 0.7).alias("passed"), F.avg("overall_score").alias("avg_score"), F.avg("latency_ms").alias("avg_latency"))


def eval_by_metric(results: DataFrame) -> DataFrame:
    m = results.select(F.explode("metrics").alias("m"))
    return m.groupBy(F.col("m.name").alias("name")).agg(F.avg("m.score").alias("avg_score"), F.avg(F.col("m.passed").cast("int")).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


def eval_overall(results: DataFrame) -> DataFrame:
    total = results.agg(F.avg("overall_score").alias("overall"), F.count_if(F.col("overall_score") >= 0.7).alias("passed"), F.count(F.lit(1)).alias("tests"), F.avg("latency_ms").alias("avg_latency"))
    return total.withColumn("verdict", M.verdict("overall"))


def synth_distribution(results: DataFrame) -> DataFrame:
    """How many rows each synthesizer made; a null one is one of its own."""
    return results.groupBy("synthesizer").agg(F.count(F.lit(1)).alias("n"))


def synth_eval_summary(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per metric (of a map<string,double>) mean and pass rate at 0.5, and per synthesizer the mean of the rows' means."""
    each = results.select("id", "synthesizer", F.explode("metrics").alias("name", "score"))
    by_metric = each.groupBy("name").agg(F.avg("score").alias("avg_score"), F.avg((F.col("score") >= 0.5).cast("int")).alias("pass_rate"))
    rows = each.groupBy("id", "synthesizer").agg(F.avg("score").alias("mean"))
    return by_metric, rows.groupBy("synthesizer").agg(F.avg("mean").alias("avg_score"), F.count(F.lit(1)).alias("n"))


def parse_question_batches(df: DataFrame, column: str = "output") -> DataFrame:
    """Rows of JSON arrays in generated text, code fences stripped; what is no array gives none."""
    bare = F.regexp_replace(F.trim(column), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return df.select("batch", F.posexplode(F.from_json(bare, "array<struct<question:string,answer:string,context_indices:array<int>>>")).alias("place", "item")).select("batch", "place", "item.*")


def resolve_contexts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with question and answer, numbered, and the first 500 characters of the chunks they point at, in the order of the indices (one given twice counts twice); indices without a chunk, and null ones, are left out."""
    good = numbered_rows(items.filter("question <> '' and answer <> ''"), "n", "batch", "place").select("n", "batch", "question", "answer", "context_indices")
    texts = chunks.select("batch", F.col("place").alias("chunk_index"), F.substring("content", 1, 500).alias("context"))
    each = good.select("*", F.posexplode_outer("context_indices").alias("at", "chunk_index")).join(texts, ["batch", "chunk_index"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("at", "context"))))
    return each.groupBy("n", "question", "answer").agg(F.transform(found, lambda x: x["context"]).alias("contexts")).select(F.concat(F.lit("RAGAS-"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("id"), "question", "answer", "contexts")


def attach_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (n, score) of a judge that saw only rows without ERROR, in order; NaN scores are left out."""
    valid = numbered_rows(results.filter(~F.startswith("response", F.lit("ERROR"))).select("id"), "n", "id")
    return results.join(valid.join(scores.filter(~F.isnan("score")), "n").select("id", "score"), "id", "left")


# --- turns and history ---------------------------------------------------------------------------------------------------------


def assemble_chat_context(hits: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """query_id, context: labelled sources with citation ids, then the images (query_id, asset_id, page_no, caption) as a list.

    The ids of one query's sources differ. Without hits there is no row.
    """
    most = F.max("rank").over(Window.partitionBy("query_id"))
    hits = hits.withColumn("_ids", T.citation_ids("query_id", most.cast("int")))
    label = T.source_label(F.get("_ids", F.col("rank") - 1), "file", "page_no", "heading_path")
    joined = lambda df, order, line, glue: df.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), glue).alias("t"))
    out = joined(hits, "rank", F.concat(label, F.lit("\n"), F.col("content")), "\n\n").withColumnRenamed("t", "context")
    if images is None:
        return out
    line = F.concat(F.lit("- [IMG-"), "asset_id", F.lit("] Page "), F.col("page_no").cast("string"), F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit(': "'), "caption", F.lit('"'))).otherwise(""))
    listed = joined(images, "asset_id", line, "\n").withColumnRenamed("t", "listed")
    return out.join(listed, "query_id", "left").select("query_id", F.concat_ws("\n\n", "context", F.concat(F.lit("Available images:\n"), "listed")).alias("context"))


def build_turns(messages: DataFrame, n: int = 2) -> DataFrame:
    """The user turns with what came right before: conv_id, turn, prompt."""
    df = history_window(messages, n).filter("role = 'user'")
    before = F.nullif(recap(F.col("history"), n), F.lit(""))
    return df.select("conv_id", "turn", F.concat_ws("\n\n", F.concat(F.lit("Earlier:\n"), before), F.concat(F.lit("Question: "), "content")).alias("prompt"))


# What stands around the parts of a user turn with sources.
TURN_HEADS = {
    "open": "I have retrieved the following document sources for you.\n\n=== DOCUMENT SOURCES ===\n", "close": "\n=== END SOURCES ===\n", "images": "Document Images:\n",
    "recap": "CONVERSATION CONTEXT (previous exchange):\n", "question": "My question: ", "user": "User: ", "other": "Assistant: ",
}


def build_user_turns(messages: DataFrame, contexts: DataFrame, images: DataFrame | None = None, rules: str = "", n: int = 2, cut: int = 300) -> DataFrame:
    """conv_id, turn, prompt of the user turns: sources, images, rules, what came right before, the question.

    contexts has the source text of a turn (conv_id, turn, context), images its lines (conv_id, turn, place, line). A turn without a
    context has empty sources; parts without text are left out; of several contexts of a turn the first by text counts.
    """
    df = history_window(messages, n).filter("role = 'user'").withColumn("_history", F.col("history"))
    df = df.join(contexts.groupBy("conv_id", "turn").agg(F.min("context").alias("_context")), ["conv_id", "turn"], "left")
    if images is not None:
        lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
        df = df.join(images.groupBy("conv_id", "turn").agg(F.array_join(lines, "\n").alias("_images")), ["conv_id", "turn"], "left")
    head = lambda k: F.lit(TURN_HEADS[k])
    who = lambda m: F.when(m["role"] == "user", head("user")).otherwise(head("other"))
    before = F.array_join(F.transform("_history", lambda m: F.concat(who(m), F.substring(F.coalesce(m["content"], F.lit("")), 1, cut))), "\n")
    parts = [F.concat(head("open"), F.coalesce("_context", F.lit("")), head("close"))]
    if images is not None:
        parts.append(F.concat(head("images"), F.col("_images"), F.lit("\n")))
    if rules:
        parts.append(F.lit(rules + "\n"))
    parts += [F.when(F.size("_history") > 0, F.concat(head("recap"), before, F.lit("\n"))), F.concat(head("question"), F.coalesce("content", F.lit("")))]
    return df.select("conv_id", "turn", F.concat_ws("\n", *parts).alias("prompt"))


def append_messages(history: DataFrame, new: DataFrame, most: int = 30) -> DataFrame:
    """The history with new rows; columns that either lacks are null there, and of a new row's related_entities the first `most` stay."""
    if "related_entities" in new.columns:
        new = new.withColumn("related_entities", F.slice("related_entities", 1, most))
    return history.unionByName(new, allowMissingColumns=True)


def clear_history(history: DataFrame, conversations: DataFrame) -> DataFrame:
    return history.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def split_sources(c: str) -> Column:
    """struct<vector, kg> of an array of sources with a field type."""
    of = lambda kind: F.filter(F.col(c), lambda s: s["type"] == kind)
    return F.struct(of("vector").alias("vector"), of("kg").alias("kg"))
