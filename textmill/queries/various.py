"""Queries of the remaining scalar rules, and of whole examples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import markup, numbers, text
from textmill.operators import budget, evalkit, filters, pack, rl, sft
from textmill.queries.base import SHARD_TOKENS, SOURCES, SQL_DOCS, SQL_TARGETS, counted, docs, mix, query, read, sources
from textmill.plans import ledger
from textmill.plans.shared import scratch
from textmill.sources import readers, tail
from textmill.sources.mix import targets

_WINDOWS_OF = 'w AS (SELECT source_id, unnest(range(0, CAST(sum(n_tokens) AS BIGINT) // 129)) AS "window" FROM docs GROUP BY source_id)'


@query("SELECT page_id, 'own/er-' || page_id AS repo, 'main' AS revision, 'a b/c.txt' AS file FROM pages")
def repository_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://host.example/own/er-"), F.col("page_id").cast("string"), F.lit("/resolve/main/a%20b/c.txt?x=1"))
    return read(spark, sf_dir, "pages").select("page_id", text.repository_parts(url).alias("p")).select("page_id", "p.*")


@query(r"SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM benchmark")
def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    fenced = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" ```python\n"), "text", F.lit("\n``` "))).otherwise(F.col("text"))
    return b.select("item_id", text.unfenced(fenced).alias("bare"))


@query("SELECT item_id, sha256(text) AS digest, CAST(item_id % 3 AS INT) AS mode, CASE item_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'fim_psm' ELSE 'fim_spm' END AS name, (item_id * 4 * 2) % 6 = 0 AS divides, CAST(least(item_id, 20) AS BIGINT) AS rows_used FROM benchmark")
def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    name = F.concat(F.get(F.array(*map(F.lit, ("standard", "fim_psm", "fim_spm"))), (i % 3).cast("int")), F.lit("_00001.ds"))
    mode = text.mode_number(name)
    return read(spark, sf_dir, "benchmark").select("item_id", text.digest("text").alias("digest"), mode.alias("mode"), text.mode_name(mode).alias("name"), numbers.divides(i, F.lit(4), F.lit(2), F.lit(6)).alias("divides"), numbers.rows_within(i, F.lit(20).cast("long")).alias("rows_used"))


@query("SELECT round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT value FROM events ORDER BY event_id LIMIT 50)")
def validation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.validation_mean(read(spark, sf_dir, "events"), 50, order="event_id", loss="value").select(F.round("mean", 6).alias("mean"), "n")


@query("SELECT ['k', 'v'] AS names")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.create_map(F.when(F.col("event_id") % 2 == 0, "k").otherwise("v"), F.col("props")).alias("m"))
    return evalkit.key_names(e, "m")


@query("SELECT conv_id AS task_no, count(*) AS n, count(*) FILTER (text = first) AS passed FROM (SELECT conv_id, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations) GROUP BY conv_id")
def passed_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    expected = c.groupBy(F.col("conv_id").alias("task_no")).agg(F.min_by("text", "turn").alias("expected"))
    return evalkit.passed_by_position(c.select(F.col("conv_id").alias("task_no"), "text"), expected)


@query("SELECT event_id, event_id % 3 <> 0 AS same FROM events")
def same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.create_map(F.lit("x"), F.col("value"), F.lit("y"), F.col("value"))
    b = F.create_map(F.lit("y"), F.col("value"), F.when(F.col("event_id") % 3 == 0, "z").otherwise("x"), F.col("value"))
    return read(spark, sf_dir, "events").select("event_id", evalkit.same_keys(a, b).alias("same"))


def _encode(x):
    return F.transform(text.words(x), lambda w: F.length(w))


@query()
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as instruction examples and documents as raw completions, through the one dispatcher."""
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    one = sft.formatted(by, _encode, group="instruction", most=64, key="conv_id").select(F.col("conv_id").alias("key"), "mode", "example.ids", "example.labels")
    two = sft.formatted(read(spark, sf_dir, "documents"), _encode, group="raw_completion", most=64, key="doc_id").select(F.col("doc_id").alias("key"), "mode", "example.ids", "example.labels")
    return one.unionByName(two)


@query("SELECT event_id, map_from_entries([('a', '[draft] x'), ('b', event_id::VARCHAR), ('c', NULL), ('d', 'true'), ('e', '{y')]) AS items FROM events")
def scalar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"e": "{y", "b": '), F.col("event_id").cast("string"), F.lit(', "c": null, "a": "[draft] x", "d": true, "list": [1, 2], "object": {"k": 1}}'))
    return read(spark, sf_dir, "events").select("event_id", filters.scalars(body).alias("items"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("parts"))
    return by.select("conv_id", rl.completion_text(F.col("parts")).alias("text"))


@query("SELECT event_id, event_type || e'\\n\\n' || event_id || e'\\n\\n' || event_type AS text FROM events")
def flatten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values of differing shapes as one text."""
    kind, n = F.col("event_type"), F.col("event_id")
    body = F.when(n % 2 == 0, F.to_json(F.struct(kind.alias("a"), F.struct(n.alias("b"), kind.alias("c")).alias("d")))).otherwise(F.concat(F.lit('["'), kind, F.lit('", null, ['), n.cast("string"), F.lit(', "'), kind, F.lit('"]]')))
    return read(spark, sf_dir, "events").select("event_id", markup.processed(body, "flatten").alias("text"))


@query("SELECT seq, least(seq % 5, 4) >= 2 AS kept FROM (SELECT doc_id AS seq FROM documents)")
def keep_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of code are kept by their own least length."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.expr("repeat('x', cast(10 * (doc_id % 5) AS int))").alias("text"))
    return d.select("seq", filters.keep_document("text", F.lit("python_code"), min_chars=1000, chunk_type=F.lit("python_function"), min_chunk_chars=20).alias("kept"))


@query("SELECT doc_id, 'src' || (doc_id % 3) AS source_id, CASE doc_id % 3 WHEN 0 THEN 'python_code' WHEN 1 THEN 'other_code' ELSE 'technical_english' END AS category, coalesce(text, '') AS text FROM documents")
def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of three sources through their descriptors, united."""
    raw = read(spark, sf_dir, "documents")
    out = None
    for i in range(3):
        own = raw.filter(F.col("doc_id") % 3 == i)
        one = readers.documents(own, replace(SOURCES[i], path_field="doc_id")).select(F.col("path").cast("long").alias("doc_id"), "source_id", "category", "text")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'café �' WHEN 1 THEN 'café' ELSE 'x' || doc_id END AS text FROM documents")
def blob_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs in their own encodings: damaged UTF-8, Latin-1, plain."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id")
    content = F.when(n % 3 == 0, F.unhex(F.lit("636166C3A920FF"))).when(n % 3 == 1, F.unhex(F.lit("636166E9"))).otherwise(F.concat(F.lit("x"), n.cast("string")).cast("binary"))
    blobs = d.select(n.cast("string").alias("blob_id"), content.alias("content"))
    file = F.struct(n.cast("string").alias("path"), F.lit("en").alias("language"), n.cast("string").alias("blob_id"), F.when(n % 3 == 1, "iso-8859-1").alias("src_encoding"), F.lit(False).alias("is_vendor"), F.lit(None).cast("boolean").alias("is_generated"))
    out = readers.bundles(d.select(F.array(file).alias("files")), blobs, SOURCES[0])
    return out.select(F.col("path").cast("long").alias("doc_id"), "text")


@query("SELECT doc_id, ['a', 'b b'] AS tasks, CASE WHEN doc_id % 2 = 0 THEN ['x', 'none', 'y'] ELSE [] END AS targets FROM documents")
def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and report targets out of comma-separated texts."""
    n = F.col("doc_id")
    args = F.array(F.lit("run"), F.lit("--tasks"), F.lit(" A ,,b B"))
    return read(spark, sf_dir, "documents").select("doc_id", text.task_names(args).alias("tasks"), text.report_targets(F.when(n % 2 == 0, "x, none,y ").when(n % 4 == 1, "None")).alias("targets"))


@query(
    f"WITH {SQL_DOCS}, {SQL_TARGETS}, sized AS (SELECT d.*, 4 * target AS target, sum(n_tokens) OVER (PARTITION BY source_id) AS total, count(*) OVER (PARTITION BY source_id) AS n, coalesce(sum(n_tokens) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs d JOIN targets USING (source_id)),"
    " p AS (SELECT *, greatest(least(16, CAST(ceil((target - before)::DOUBLE / total) AS BIGINT)), 0) AS passes FROM sized), t AS (SELECT source_id, max(target) AS target_tokens, CAST(sum(n_tokens * passes) AS BIGINT) AS actual_tokens, CAST(sum(CASE WHEN n_tokens > 0 THEN passes ELSE 0 END) AS BIGINT) AS documents, CAST(sum(passes) AS BIGINT) AS examples_consumed, max(n) AS n FROM p GROUP BY source_id HAVING sum(passes) > 0)"
    ' SELECT source_id, target_tokens, actual_tokens, documents, examples_consumed, (3 + examples_consumed) // n AS epochs_completed, 2 + (3 + examples_consumed) // n AS epoch, (3 + examples_consumed) % n AS "offset", 0::BIGINT AS stream_retries FROM t'
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycled shard took from each source, from a cursor at epoch 2, offset 3."""
    d, s = counted(spark, sf_dir), sources(spark)
    taken = budget.cycle(d, targets(s, mix(spark), SHARD_TOKENS).withColumn("target", 4 * F.col("target")))
    cursor = s.select("source_id", F.lit(2).cast("long").alias("epoch"), F.lit(3).cast("long").alias("offset"))
    out = budget.source_stats(d, taken, cursor)
    return out.select("source_id", "target_tokens", F.col("actual_tokens").cast("long").alias("actual_tokens"), "documents", "examples_consumed", "epochs_completed", "epoch", "offset", F.col("stream_retries").cast("long").alias("stream_retries"))


@query("SELECT event_id AS step, round(CASE WHEN event_id < 500 THEN 3e-4::DOUBLE * (0.05 + 0.95 * event_id / 500.0::DOUBLE) ELSE 3e-5::DOUBLE + (3e-4::DOUBLE - 3e-5::DOUBLE) * 0.5 * (1 + cos(pi() * least((event_id - 500) / 4500.0::DOUBLE, 1.0))) END, 10) AS rate, CAST(ceil(event_id / 7.0) AS BIGINT) AS steps FROM events")
def lr_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return s.select("step", F.round(numbers.learning_rate_by_ratio(F.col("step"), 3e-4, 0.1, 5000), 10).alias("rate"), numbers.total_steps(F.col("step"), F.lit(7)).alias("steps"))


@query("SELECT event_id FROM events QUALIFY sum(strlen(event_id || ' ' || event_type) + 1) OVER (ORDER BY event_id DESC) < 4096")
def log_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines in the last four kilobytes of the events as a log of several files, read from its end."""
    path = scratch(spark, "log")
    lines = read(spark, sf_dir, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.concat_ws(" ", "event_id", "event_type").alias("value"))
    lines.write.text(path)
    return tail.tail_lines(spark, path, 4096).select(F.split("value", " ")[0].cast("long").alias("event_id"))


@query(
    "WITH s AS (SELECT l_suppkey % 8 AS id, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1) SELECT id, n AS actual_tokens, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS tokens_start, CAST(sum(n) OVER (ORDER BY id) AS BIGINT) AS tokens_end, 'built' AS status FROM s"
)
def ledger_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards put into the shared manifest one after the other, and read from its last state."""
    own = ledger.Ledger(spark, scratch(spark, "ledger"))
    shards = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("id")).agg(F.sum("l_quantity").cast("long").alias("actual_tokens")).orderBy("id")
    for shard in shards.collect():  # eight rows
        own.change(lambda state, shard=shard: ledger.with_shard(state, shard.asDict()))
    return spark.createDataFrame(own.read()[1]["shards"], "id long, actual_tokens long, tokens_start long, tokens_end long, status string")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS told, round(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2020-01-01'), 3) AS seconds FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", text.iso_time(F.col("ts").cast("timestamp")).alias("told"))
    return e.select("event_id", "told", F.round(text.elapsed_seconds(F.lit("2020-01-01T00:00:00+00:00"), "told"), 3).alias("seconds"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit on training rows, clamped to the table."""
    return budget.limited(read(spark, sf_dir, "documents").select("doc_id"), 100, order="doc_id")


@query(f"WITH {SQL_DOCS}, {_WINDOWS_OF} SELECT source_id, \"window\", row_number() OVER (ORDER BY md5('9#' || source_id || '#' || \"window\")) - 1 AS place FROM w")
def window_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows in seeded order."""
    d = docs(spark, sf_dir).select("source_id", "seq", text.words("text").alias("tokens"))
    return pack.shuffled(pack.windows(d, 129, key="source_id", order="seq"), 9, key="source_id").select("source_id", "window", "place")
