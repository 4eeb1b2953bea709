"""Structured Streaming jobs: answers put together from tokens, document status, stale documents, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgraph.operators.chat import status_columns
from corpusgraph.sources.batches import put_batch, read_batches
from corpusgraph.sources.shared import scratch, write_table


def replay(df: DataFrame, files: int = 4) -> DataFrame:
    """A table as a stream of a few files, to drive the streaming jobs over given rows."""
    path = scratch(df.sparkSession, "replay")
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay_in_order(df: DataFrame, by: str, files: int = 4) -> DataFrame:
    """A table as a stream of a few files, each of later rows (by a time) than the one before, as a log brings them."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "replay")
    at = F.unix_micros(F.col(by).cast("timestamp"))
    cuts = df.select(at.alias("at")).approxQuantile("at", [i / files for i in range(1, files)], 0.01)
    marked = write_table(df.withColumn("_file", sum(((at > c).cast("int") for c in cuts), F.lit(0))), "log")
    for i in range(files):  # one after the other, as a file source reads the oldest first
        marked.filter(F.col("_file") == i).drop("_file").coalesce(1).sortWithinPartitions(by).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_appended(spark: SparkSession, stream: DataFrame) -> tuple[DataFrame, list]:
    """Run a stream that only adds rows over what is there: its rows, and the rows of state after each batch."""
    path, kept = scratch(spark, "stream-out"), []
    run = stream.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    kept = [sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in run.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(path).select(stream.columns), kept


def run_to_table(spark: SparkSession, stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Run a stream over what is there; of the rows it gave for a key, those of the highest version."""
    path = scratch(spark, "stream-out")
    sink = lambda batch, _: batch.write.mode("append").parquet(path)
    stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r")


def assemble_answers_stream(events: DataFrame) -> DataFrame:
    """session, answer, done, version after each batch: tokens by sequence number, those before the last rollback dropped, whatever order the events come in.

    An answer is given anew after each batch that brings events of its session, so a session's tokens stay in state; where answers end,
    closed_answers_stream lets go of them.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, tokens, cut, done, version = state.get if state.exists else ([], [], -1, False, 0)
        live = dict(zip(seqs, tokens, strict=True))
        for b in batches:
            for seq, event, data in zip(b["seq"], b["event"], b["data"], strict=True):
                if event == "token":
                    live[int(seq)] = data
                elif event == "token_rollback":
                    cut = max(cut, int(seq))
                elif event == "complete":
                    done = True
        live = {s: live[s] for s in sorted(live) if s > cut}
        state.update((list(live), list(live.values()), cut, done, version + 1))
        yield pd.DataFrame({"session": [key[0]], "answer": ["".join(live.values())], "done": [done], "version": [version + 1]})

    return events.groupBy("session").applyInPandasWithState(update, "session string, answer string, done boolean, version long", "seqs array<long>, tokens array<string>, cut long, done boolean, version long", "update", GroupStateTimeout.NoTimeout)


#: Name of events that only carry the time on, as a log's heartbeat does.
TICK = "tick"
ANSWER = "session string, first_seq long, last_seq long, answer string, done boolean"


def closed_answers_stream(events: DataFrame, quiet: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """session, first_seq, last_seq, answer, done: each answer of a session once it is over, of a stream of events (session, seq, ts, event, data).

    An answer ends with its `complete` (done), or when its session is quiet for longer than `quiet` (not done); what follows is another
    one. Events may come in any order within `late` (later ones are dropped), and are put in order of time, then seq. A session's state
    holds the events of answers that are not over yet: as soon as the watermark has passed an answer's end it is given out and its
    events are dropped, and a session without open events has no state. Events without tokens make an empty answer; null data counts
    as empty; ticks only move the time.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms, seqs, kinds, texts = state.get if state.exists else ([], [], [], [])
        rows = list(zip(ms, seqs, kinds, texts, strict=True))
        for b in batches:
            b = b[b["event"] != TICK]
            rows += zip(b["ms"].tolist(), b["seq"].tolist(), b["event"].tolist(), [x or "" for x in b["data"]], strict=True)
        rows.sort()
        now, out, start, i = state.getCurrentWatermarkMs(), [], 0, 0
        while i < len(rows):
            over = rows[i][2] == "complete"
            end = rows[i][0] + (0 if over else quiet_ms)
            if over or i + 1 == len(rows) or rows[i + 1][0] - rows[i][0] > quiet_ms:
                if now <= end:  # more of it may come, and so nothing after it is certain
                    break
                part = rows[start : i + 1]
                cut = max((s for _, s, k, _ in part if k == "token_rollback"), default=None)
                tokens = sorted((s, t) for _, s, k, t in part if k == "token" and (cut is None or s > cut))
                out.append((key[0], min(s for _, s, _, _ in part), max(s for _, s, _, _ in part), "".join(t for _, t in tokens), over))
                start = i + 1
            i += 1
        rows = rows[start:]
        if rows:
            state.update(tuple(list(x) for x in zip(*rows, strict=True)))
            ends = next((a[0] if a[2] == "complete" else a[0] + quiet_ms for a, b in zip(rows, [*rows[1:], None], strict=True) if a[2] == "complete" or b is None or b[0] - a[0] > quiet_ms))
            state.setTimeoutTimestamp(max(ends, now) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "first_seq", "last_seq", "answer", "done"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("session").applyInPandasWithState(update, ANSWER, "ms array<long>, seqs array<long>, kinds array<string>, texts array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def closed_answers(events: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """The batch twin of closed_answers_stream: all answers that are over when the last event's time has come (a session still open gives none)."""
    rows = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    last, quiet_ms = rows.agg(F.max("ms").alias("last")), int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = rows.filter(F.col("event") != TICK)
    order = Window.partitionBy("session").orderBy("ms", "seq")
    fresh = F.coalesce((F.lag("event").over(order) == "complete") | (F.col("ms") - F.lag("ms").over(order) > quiet_ms), F.lit(True))
    rows = rows.withColumn("_new", fresh).withColumn("part", F.sum(F.col("_new").cast("int")).over(order))
    cut = F.max(F.when(F.col("event") == "token_rollback", F.col("seq"))).over(Window.partitionBy("session", "part"))
    live = (F.col("event") == "token") & (F.col("seq") > F.coalesce(cut, F.lit(-(1 << 62))))
    token = F.when(live, F.struct("seq", F.coalesce("data", F.lit("")).alias("data")))
    answers = rows.withColumn("_token", token).groupBy("session", "part").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_join(F.transform(F.sort_array(F.collect_list("_token")), lambda x: x["data"]), "").alias("answer"),
        F.max(F.col("event") == "complete").alias("done"), F.max("ms").alias("_end"),
    )
    over = answers.crossJoin(F.broadcast(last)).filter(F.col("last") > F.col("_end") + F.when(F.col("done"), 0).otherwise(quiet_ms))  # one row
    return over.select("session", "first_seq", "last_seq", "answer", "done")


def document_status_stream(events: DataFrame) -> DataFrame:
    """document_id, status, seq, elapsed_us, error of each document (see status_columns), and version, its events so far."""
    return events.groupBy("document_id").agg(*status_columns(events), F.count(F.lit(1)).alias("version"))


def stale_documents_stream(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Sessions of status events that went quiet for `minutes` while in progress (event time)."""
    quiet = events.withWatermark("ts", "0 seconds").groupBy("document_id", F.session_window("ts", f"{minutes} minutes")).agg(F.max(F.struct("ts", "seq", "status")).alias("at"))
    return quiet.filter(F.col("at.status").isin("PARSING", "PROCESSING", "INDEXING")).select("document_id", F.col("at.ts").alias("last_ts"), F.lit("FAILED").alias("status"))


# --- ingest --------------------------------------------------------------------------------------------------------------------

DOCUMENT = ["document_id"]


def replace_documents(spark: SparkSession, rows: DataFrame, path: str, batch: int, documents: DataFrame | None = None) -> None:
    """Rows of a batch take the place of what the table at path holds of their documents, and of the documents given besides, which may have no rows now.

    What is written is the batch (see put_batch), so it can run twice, and two writers with numbers of their own do not meet.
    """
    put_batch(rows, path, DOCUMENT, batch, documents)


def read_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all documents as last written, with batch; None before the first batch."""
    return read_batches(spark, path, DOCUMENT)


def latest_documents(documents: DataFrame, order: str) -> DataFrame:
    """Of a document given more than once the row that is last by order (ties: by text)."""
    rest = [c for c in documents.columns if c not in ("document_id", order, "text")]
    last = F.max(F.struct(order, "text", *rest)).alias("_x")
    return documents.groupBy("document_id").agg(last).select("document_id", "_x.*").select(*documents.columns)


def prepare_documents(documents: DataFrame, images: DataFrame | None = None, tables: DataFrame | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The chunks of documents (document_id, text: Markdown with page separators) as they are searched, with embedding.

    Pages, sections and pieces with their assets; noise, exact and near copies within a document go, and what is left is numbered anew
    (chunk_index; old_index is the number before). embedder adds an embedding to chunks with content; the offline model's unless given.
    """
    from corpusgraph.operators.chunking import chunk_markdown
    from corpusgraph.operators.dedup import deduplicate
    from corpusgraph.operators.vectors import hashed_embeddings

    kept = write_table(deduplicate(write_table(chunk_markdown(documents, images=images, tables=tables), "chunks")), "kept-chunks")
    if embedder is not None:
        return embedder(kept)
    rows = kept.select(F.struct(*kept.columns).alias("row"), "content")
    return hashed_embeddings(rows, "row", "content").select("row.*", "embedding")


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = prepare_documents, order: str | None = None):
    """New documents go through prepare and take the place of their rows in the table at path, micro-batch by micro-batch.

    A batch is written under its own number, so one that runs again after a failure leaves the same table. Of a document that stands
    twice in a batch the last by `order` counts; a document all of whose chunks are dropped has no rows. The keys of the table hold
    n_chunks of each document.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        docs = write_table(latest_documents(batch, order) if order else batch.dropDuplicates(DOCUMENT), "ingest-batch")
        rows = write_table(prepare(docs), "ingest-rows")
        counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        named = docs.select("document_id").join(counts, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))
        replace_documents(spark, rows, path, number, named)

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the given documents as a stream of lines and count each document's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    lines = lambda b: b.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    path = scratch(spark, "ingested")
    ingest_stream(replay(docs, 2), path, scratch(spark, "ingest-state"), lines).awaitTermination()
    return read_documents(spark, path).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def ingest_chunks(spark: SparkSession, documents: DataFrame, files: int = 2) -> DataFrame:
    """Ingest documents (document_id, text, ...) as a stream and read the chunks that are searched."""
    path = scratch(spark, "ingested")
    ingest_stream(replay(documents, files), path, scratch(spark, "ingest-state")).awaitTermination()
    return read_documents(spark, path)
