"""Queries of streams that resume at a row, keyed state, listeners, sessions and joins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import words
from textmill.operators import budget
from textmill.plans.shared import scratch
from textmill.queries.base import SHARD_TOKENS, SQL, SQL_WORDS, mix, query, read, sources
from textmill.queries.evaluation import event_files
from textmill.sources.mix import targets
from textmill.streaming import books, corpus, flows, listen



@query(SQL["budget_cycle"])
def stream_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources read again and again as a stream with an offset, epoch by epoch, until each has its tokens."""
    root = scratch(spark, "cycle")
    stream = corpus.corpus_stream(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source", "text"], root=root, epochs=16, batch_tokens=1 << 40)
    rows = corpus.exhausted(stream.select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), "epoch", F.size(words("text")).cast("long").alias("n_tokens")), root)
    t = targets(sources(spark), mix(spark), SHARD_TOKENS).withColumn("target", 4 * F.col("target"))
    passes = rows.withColumn("order", F.col("epoch") * F.lit(1 << 40) + F.col("seq"))
    taken = budget.take(passes, t, order="order")
    return taken.groupBy("source_id", "seq").agg(F.count("*").cast("int").alias("passes"))


@query(
    f"WITH d AS (SELECT coalesce(source, '') AS source, doc_id, CAST(len({SQL_WORDS}) AS BIGINT) AS n, CASE WHEN len({SQL_WORDS}) = 0 THEN 'blank' WHEN lang IS NULL THEN 'no language' END AS error, lang FROM documents),"
    " good AS (SELECT source, max(doc_id) FILTER (error IS NULL) AS last FROM d GROUP BY source)"
    " SELECT source, CAST(coalesce(sum(n) FILTER (error IS NULL AND lang = 'en'), 0) AS BIGINT) AS tokens, count(*) FILTER (error IS NULL AND lang = 'en') AS documents, count(*) AS examples, count(error) AS errors,"
    " count(*) FILTER (error IS NOT NULL AND doc_id > coalesce(last, -1)) AS failing, count(*) FILTER (error = 'blank') AS blank FROM d JOIN good USING (source) GROUP BY source"
)
def stream_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, documents, examples and errors of each source after the last of several batches."""
    root, path = scratch(spark, "books"), f"{sf_dir}/documents.parquet"
    size = F.size(words("text")).cast("long")
    most = -(-read(spark, sf_dir, "documents").count() // 4)
    stream = corpus.corpus_stream(spark, path, ["doc_id", "source", "lang", "text"], root=root, batch_tokens=most, slice_rows=200)
    error = F.when(F.col("n") == 0, "blank").when(F.col("lang").isNull(), "no language")
    rows = stream.select("doc_id", "source", "lang", size.alias("n")).withColumn("error", error)
    rows = rows.withColumn("kept", F.col("error").isNull() & (F.col("lang") == "en"))
    found = corpus.exhausted(books.source_books(rows, source="source", order="doc_id", tokens="n", kept="kept", error="error"), root, mode="update")
    last = found.groupBy("source").agg(F.max_by(F.struct(*found.columns), "batch_id").alias("r")).select("r.*")
    return last.select("source", "tokens", "documents", "examples", "errors", "failing", F.coalesce(F.try_element_at("kinds", F.lit("blank")), F.lit(0)).cast("long").alias("blank"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY event_type")
def stream_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer makes shards of a stream, two ahead at most; a consumer waits for each of them, and would build it itself if none came."""
    root, path = scratch(spark, "shards"), f"{sf_dir}/events.parquet"
    n = read(spark, sf_dir, "events").count()
    stream = corpus.corpus_stream(spark, path, ["event_id", "event_type"], root=root, batch_tokens=-(-n // 6), slice_rows=max(1, n // 24), seed=5, most_waiting=2)
    progress, folder, out = listen.listening(spark), f"{root}/batches", []
    writer = stream.writeStream.foreachBatch(flows.committed_once(root)).trigger(processingTime="100 milliseconds").option("checkpointLocation", f"{root}/checkpoint")
    query_ = writer.start()
    schema = read(spark, sf_dir, "events").select("event_id", "event_type").schema

    def ready() -> int | None:
        # a batch is whole once a later one has begun or the query has told of it
        done = progress.of(query_).batches
        return next((k for k in corpus.unconsumed(folder) if k < done), None)

    try:
        taken = 0
        while taken < n:
            shard, here = listen.next_shard(ready, lambda: -1, query_, progress, longest_s=120, poll_s=1)
            if here:
                raise RuntimeError(f"the producer ended after {taken} of {n} rows: {progress.of(query_).error}")
            rows = spark.read.schema(schema).parquet(f"{folder}/batch_id={shard}")
            taken += rows.count()
            out.append(f"{folder}/batch_id={shard}")
            corpus.consume(folder, shard)
    finally:
        query_.stop()
        spark.streams.removeListener(progress)
    return spark.read.schema(schema).parquet(*out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each kind, as a stream in update mode keeps it."""
    e = event_files(spark, sf_dir).select("event_type", "event_id", "value")
    return flows.upserted(flows.latest_stream(e, kind="event_type", order="event_id"), scratch(spark, "latest"), "event_type")


@query(
    "WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)"
    " SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"
)
def ext_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: users' sessions, events less than two hours apart."""
    e = event_files(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = flows.drained(flows.sessions(e, at="ts", key="user_id", gap="2 hours"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY ALL")
def ext_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows of an hour every half hour."""
    e = event_files(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = flows.drained(flows.counted_windows(e, at="ts", kind="event_type", size="1 hour", slide="30 minutes"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT a.event_id, b.event_id AS next_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def ext_stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: clicks and the purchases of the same user within six hours, two streams joined."""
    one, two = (event_files(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("click", "purchase"))
    return flows.drained(flows.paired(one, two, key="user_id", at="ts", within="6 HOURS").select("event_id", "next_event_id"))
