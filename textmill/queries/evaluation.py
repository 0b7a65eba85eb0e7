"""Queries of vectors, evaluation bookkeeping, the manifest and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import numbers
from textmill.functions.text import file_name, step_number, strip_prefixes, uniform
from textmill.operators import evalkit, sampling
from textmill.plans import manifest
from textmill.queries.base import query, read, sql_uniform
from textmill.streaming import flows

_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", sampling.softmax(F.col("embedding"), 0.7).alias("p"))


@query(f"WITH {_E} SELECT vec_id, CAST(id AS INT) AS id, round(z, 6) AS z, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, id) AS INT) AS place FROM e QUALIFY place <= 5")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sampling.top_k(F.col("embedding"), 5)).alias("place", "x"))
    return e.select("vec_id", "x.id", F.round("x.z", 6).alias("z"), (F.col("place") + 1).alias("place"))


@query("SELECT l_orderkey AS key, CAST(l_linenumber AS INT) AS id, l_quantity AS z FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) <= 2")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("id"), F.col("l_quantity").alias("z"))
    return sampling.top_k_with_ties(rows, 2, key="key").drop("place")


_P = f"{_E}, p AS (SELECT vec_id, id, z, exp((z - max(z) OVER w) / 0.7::DOUBLE) AS x FROM e WINDOW w AS (PARTITION BY vec_id)), s AS (SELECT vec_id, id, z, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM p)"


@query(f"WITH {_P} SELECT vec_id, CAST(id AS INT) AS id, round(p, 6) AS p FROM s")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("vec_id", F.posexplode("p").alias("id", "p")).withColumn("p", F.round("p", 6))


@query(f"WITH {_P} SELECT vec_id, count(*) AS n, round(sum(p), 6) AS mass FROM (SELECT vec_id, p, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY z DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) WHERE b <= 0.8 GROUP BY vec_id")
def nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _probabilities(spark, sf_dir).select("vec_id", sampling.nucleus(F.col("p"), 0.8).alias("x"))
    return kept.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x["z"]), 6).alias("mass"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS id FROM embeddings")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", sampling.argmax(F.col("embedding")).alias("id"))


@query(f"WITH {_P} SELECT vec_id, CAST(min(id) AS INT) AS id FROM (SELECT vec_id, id, sum(p) OVER (PARTITION BY vec_id ORDER BY id) AS upto FROM s) WHERE upto > {sql_uniform("'42'", 'vec_id')} GROUP BY vec_id")
def multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("vec_id", sampling.multinomial(F.col("p"), uniform("42", F.col("vec_id"))).alias("id"))


@query(
    f"WITH u AS (SELECT doc_id, {sql_uniform("'42'", 'doc_id', "'group'")} AS g, {sql_uniform("'42'", 'doc_id', "'source'")} AS s FROM documents)"
    ' SELECT doc_id, CASE WHEN g < 0.7::DOUBLE / 1.0 THEN \'instruction\' ELSE \'raw\' END AS "group", CASE WHEN g < 0.7::DOUBLE THEN CASE WHEN s < 0.25 THEN \'a\' ELSE \'b\' END ELSE \'c\' END AS source_id FROM u'
)
def mixture_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("instruction", 0.7), ("raw", 0.3), ("none", 5.0)], "group string, weight double")
    of = spark.createDataFrame([("instruction", "a", 1.0), ("instruction", "b", 3.0), ("raw", "c", 1.0), ("raw", "d", -2.0)], "group string, source_id string, weight double")
    return sampling.choose(read(spark, sf_dir, "documents").select("doc_id"), groups, of, key="doc_id", seed=42)


@query("WITH c AS (SELECT i AS expert, count(label) AS n FROM range(12) t(i) LEFT JOIN embeddings ON label = i GROUP BY i) SELECT CAST(expert AS INT) AS expert, n, CAST(sign((SELECT avg(n) FROM c) - n) AS INT) AS \"update\" FROM c")
def expert_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.expert_balance(read(spark, sf_dir, "embeddings"), 12, expert="label")


@query(f"WITH {_P}, f AS (SELECT id, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, id) = 1 AS first FROM s), b AS (SELECT id, avg(first::INT) AS share, avg(p) AS mean FROM f GROUP BY id) SELECT round(64 * sum(share * mean), 6) AS loss FROM b")
def router_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.router_loss(_probabilities(spark, sf_dir), F.col("p"), 64).select(F.round("loss", 6).alias("loss"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT d, coalesce(avg(z) FILTER (label = 3), avg(z)) AS v FROM x GROUP BY d) SELECT list(round(v, 6) ORDER BY d) AS mean FROM m")
def embedding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sampling.mean_vector(read(spark, sf_dir, "embeddings"), "embedding", F.col("label") == 3)
    return m.select(F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query("SELECT a.vec_id, round(list_max(d), 6) AS largest, round(list_avg(d), 6) AS mean FROM (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a")
def vector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    largest, mean = sampling.difference(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(largest, 6).alias("largest"), F.round(mean, 6).alias("mean"))


@query("SELECT event_type AS mode, round(coalesce(sum(value), 0), 4) AS total, count(event_type) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY event_type UNION ALL SELECT 'none', 0.0, 0, 0.0")
def loss_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumnRenamed("event_type", "mode")
    modes = e.select("mode").distinct().unionByName(spark.createDataFrame([("none",)], "mode string"))
    out = evalkit.loss_by_mode(e, modes, mode="mode", loss="value")
    return out.select("mode", F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, round(coalesce(list_sum(list_filter(embedding, lambda z: z > 0))::DOUBLE, 0) / greatest(len(list_filter(embedding, lambda z: z > 0)), 1), 5) AS mean FROM embeddings")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(evalkit.masked_mean(z, F.transform(z, lambda x: x > 0)), 5).alias("mean"))


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(sum(mean * n) / sum(n), 6) AS loss FROM m GROUP BY user_id")
def combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return m.groupBy("user_id").agg(F.round(evalkit.combined_mean(F.col("mean"), F.col("n")), 6).alias("loss"))


_EMA = (
    "WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), m AS (SELECT user_id, event_id, r, value AS ema, value AS least FROM s WHERE r = 1"
    " UNION ALL SELECT s.user_id, s.event_id, s.r, 0.9::DOUBLE * m.ema + 0.1::DOUBLE * s.value, least(m.least, 0.9::DOUBLE * m.ema + 0.1::DOUBLE * s.value) FROM m JOIN s ON s.user_id = m.user_id AND s.r = m.r + 1)"
)


@query(f"{_EMA} SELECT user_id, event_id, round(ema, 6) AS ema, round(least, 6) AS least FROM m")
def loss_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return evalkit.ema_rows(e, run="user_id", order="event_id", value="value").select("user_id", "event_id", F.round("ema", 6).alias("ema"), F.round("least", 6).alias("least"))


@query(f"{_EMA} SELECT user_id, round(max_by(ema, r), 6) AS last FROM m GROUP BY user_id")
def ema_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", F.round(F.element_at(evalkit.ema(F.transform("v", lambda x: x["value"])), -1), 6).alias("last"))


@query(
    "SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 3e-4::DOUBLE * (event_id + 1) / 100 ELSE 3e-5::DOUBLE + (3e-4::DOUBLE - 3e-5::DOUBLE) * 0.5 * (1 + cos(pi() * least((event_id - 100) / 4900.0::DOUBLE, 1.0))) END, 10) AS rate,"
    " CAST((event_id // 250 + 1) * 250 AS BIGINT) AS next_eval, round(least(60.0::DOUBLE, 2 * pow(2, greatest(event_id % 8 - 1, 0))), 6) AS wait FROM events"
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return s.select("step", F.round(numbers.learning_rate(F.col("step"), 3e-4, 3e-5, 100, 5000), 10).alias("rate"), numbers.next_multiple(F.col("step"), 250).alias("next_eval"), F.round(numbers.back_off(F.col("step") % 8, 2.0, 60.0), 6).alias("wait"))


@query("SELECT event_id, (event_id // 500 + 1) * 500 AS due FROM events")
def eval_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", numbers.next_multiple(F.col("event_id"), 500).alias("due"))


@query("SELECT user_id, event_id, value AS score FROM (SELECT user_id, event_id, round(value, 0) AS p, event_id % 7 AS t, value FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, t DESC, event_id) = 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value", F.rint("value").alias("p"), (F.col("event_id") % 7).cast("double").alias("t")).withColumn("p", F.round("value", 0))
    return evalkit.best_so_far(e, run="user_id", order="event_id", primary="p", tie="t").select("user_id", "event_id", F.col("value").alias("score"))


#: Scores in steps, some of them closer than the band; a tie-break score that is missing now and then.
_SCORES = "s AS (SELECT user_id, event_id, round(value / 5, 0) * 5 + (event_id % 4) * 4e-13::DOUBLE AS p, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7)::DOUBLE + (event_id % 3) * 6e-13::DOUBLE END AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)"


@query(
    f"WITH RECURSIVE {_SCORES}, f AS (SELECT user_id, event_id, r, true AS improved, p AS best, event_id AS best_order, t IS NOT NULL AS tie_improved, t AS best_tie, CASE WHEN t IS NOT NULL THEN event_id END AS best_tie_order FROM s WHERE r = 1"
    " UNION ALL SELECT s.user_id, s.event_id, s.r, p > best + 1e-12::DOUBLE, CASE WHEN p > best + 1e-12::DOUBLE THEN p ELSE best END, CASE WHEN p > best + 1e-12::DOUBLE THEN s.event_id ELSE best_order END,"
    " t IS NOT NULL AND (p > best + 1e-12::DOUBLE OR (abs(p - best) <= 1e-12::DOUBLE AND (best_tie IS NULL OR t > best_tie + 1e-12::DOUBLE))),"
    " CASE WHEN p > best + 1e-12::DOUBLE THEN t WHEN t IS NOT NULL AND abs(p - best) <= 1e-12::DOUBLE AND (best_tie IS NULL OR t > best_tie + 1e-12::DOUBLE) THEN t ELSE best_tie END,"
    " CASE WHEN p > best + 1e-12::DOUBLE THEN CASE WHEN t IS NOT NULL THEN s.event_id END WHEN t IS NOT NULL AND abs(p - best) <= 1e-12::DOUBLE AND (best_tie IS NULL OR t > best_tie + 1e-12::DOUBLE) THEN s.event_id ELSE best_tie_order END"
    " FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1) SELECT user_id, event_id, improved, best_order, tie_improved, best_tie_order, round(best, 6) AS best, round(best_tie, 6) AS best_tie FROM f"
)
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best checkpoint after each evaluation, with its tie-break."""
    i = F.col("event_id")
    p = F.round(F.col("value") / 5, 0) * 5 + (i % 4) * F.lit(4e-13)
    t = F.when(i % 5 != 0, (i % 7).cast("double") + (i % 3) * F.lit(6e-13))
    e = read(spark, sf_dir, "events").select("user_id", "event_id", p.alias("p"), t.alias("t"))
    out = evalkit.running_best(e, run="user_id", order="event_id", primary="p", tie="t")
    return out.select("user_id", "event_id", "improved", "best_order", "tie_improved", "best_tie_order", F.round("best", 6).alias("best"), F.round("best_tie", 6).alias("best_tie"))


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE NULL END::BIGINT AS priority FROM events GROUP BY event_type")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return evalkit.latest_events(e, kind="event_type", order="event_id", priority=["purchase", "click"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    score = F.when(i % 4 == 0, F.concat(F.lit('"'), F.round("value", 3).cast("string"), F.lit('%"'))).when(i % 4 == 1, F.round("value", 3).cast("string")).when(i % 4 == 2, "true").otherwise('"nan"')
    body = F.concat(F.lit('{"results": {"mbpp": {"pass@1": 0.25}, "HumanEval-x": {"detail": {"n": 3}, "pass_at_1": '), score, F.lit("}}}"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.results").alias("payload"))


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN round(value, 3) / 100 ELSE round(value, 3) END, 8) AS score FROM events WHERE event_id % 4 < 2")
def metric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = evalkit.flattened(_results(spark, sf_dir), key="event_id", payload="payload")
    return evalkit.task_score(flat, "humaneval", "pass@1", key="event_id").select("event_id", F.round("score", 8).alias("score"))


@query("SELECT event_id, 0.25::DOUBLE AS score FROM events")
def metric_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = evalkit.flattened(_results(spark, sf_dir), key="event_id", payload="payload")
    return evalkit.task_score(flat.filter("names[0] = 'mbpp'"), "absent", "pass@1", key="event_id", anywhere=True)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.5 ELSE 0.75 END AS score FROM events")
def metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's own metric counts before nested ones, and so does what a key of the metric's name holds; keys may hold slashes."""
    i = F.col("event_id")
    body = F.when(i % 3 == 0, '{"a": {"x": {"pass@1": 0.1}, "pass@1": 0.2}}').when(i % 3 == 1, '{"a/b": [{"x": {"pass@1": 0.9}, "pass@1": {"deep": {"pass_at_1": "50%"}}}]}').otherwise('{"x": {"y/z": {"pass@1": "nan"}}, "y": {"pass@1": 0.75}, "z": [0.1]}')
    flat = evalkit.flattened(read(spark, sf_dir, "events").select("event_id", body.alias("payload")), key="event_id", payload="payload")
    return evalkit.named_metric(flat, "pass@1", key="event_id")


@query(
    "SELECT event_id, task, CASE task WHEN 'humaneval' THEN round(CASE event_id % 4 WHEN 0 THEN round(value, 3) / 100 WHEN 1 THEN round(value, 3) ELSE 0.25 END, 8) WHEN 'mbpp' THEN 0.25 END AS score"
    " FROM events, (VALUES ('mbpp'), ('apps'), ('humaneval')) t(task)"
)
def metric_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task of a command, the primary one with its fallback."""
    flat = evalkit.flattened(_results(spark, sf_dir), key="event_id", payload="payload")
    out = evalkit.task_scores(flat, ["mbpp", "apps"], "pass@1", key="event_id", primary="HumanEval", tie="mbpp")
    return out.select("event_id", "task", F.round("score", 8).alias("score"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c, round(CASE WHEN n - c < 2 THEN 1.0 ELSE 1 - ((n - c)::DOUBLE / n) * ((n - c - 1)::DOUBLE / (n - 1)) END, 6) AS pass_at_2 FROM events GROUP BY user_id HAVING count(*) >= 2")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c")).filter("n >= 2")
    return e.select("user_id", "n", "c", F.round(numbers.pass_at_k(F.col("n"), F.col("c"), 2), 6).alias("pass_at_2"))


@query("SELECT printf('step_%08d', event_id) AS name FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) > 100")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "events").select(F.format_string("step_%08d", "event_id").alias("name")).unionByName(spark.createDataFrame([("best",)], "name string"))
    return manifest.superfluous(names, 100, slots=["best"])


@query("SELECT event_id FROM events QUALIFY sum(strlen(props) + 1) OVER (ORDER BY event_id DESC) <= 5000")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.newest_within(read(spark, sf_dir, "events").select("event_id", "props"), 5000, order="event_id", text="props").select("event_id")


@query("SELECT user_id AS shard_id, arg_max(event_type, event_id) AS status, max(event_id) AS \"at\" FROM events GROUP BY user_id")
def status_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("shard_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return manifest.current_status(e)


@query("WITH s AS (SELECT user_id AS shard_id, CASE user_id % 3 WHEN 0 THEN 'trained' WHEN 1 THEN 'built' ELSE 'training' END AS status FROM events GROUP BY user_id) SELECT min(shard_id) AS shard_id, count(*) AS waiting FROM s WHERE status <> 'trained'")
def next_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("shard_id") % 3
    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("shard_id")).distinct().withColumn("status", F.when(n == 0, "trained").when(n == 1, "built").otherwise("training"))
    return manifest.next_shard(s).select("shard_id").join(F.broadcast(manifest.waiting(s)))


@query("WITH m AS (SELECT user_id, event_type = 'error' OR value < 20 AS f, sum(CASE WHEN event_type = 'error' OR value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), n AS (SELECT user_id, island, sum(f::INT) AS n FROM m GROUP BY ALL) SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM n GROUP BY user_id")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.longest_failures(read(spark, sf_dir, "events"), run="user_id", order="event_id", failed=(F.col("event_type") == "error") | (F.col("value") < 20))


@query(
    "WITH s AS (SELECT l_suppkey AS id, sum(l_quantity) / 1000.0::DOUBLE AS gib, count(*) AS n, CASE WHEN 60000 + l_suppkey % 12 * 1000 < 65535 THEN 2 ELSE 4 END AS width FROM lineitem GROUP BY l_suppkey)"
    " SELECT id, width, least(CAST(floor(gib * 1073741824.0::DOUBLE * 0.8::DOUBLE / (4.0::DOUBLE + width + 0.05::DOUBLE)) AS BIGINT), 1000000000) AS tokens, CAST(8 * 2048 * 16 * n AS BIGINT) AS step_tokens FROM s"
)
def shard_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens a shard may have: suppliers as machines with a disk, a vocabulary and a number of processes."""
    r = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.sum("l_quantity") / 1000.0).alias("gib"), F.count("*").alias("n"))
    width = numbers.token_width(F.lit(60000) + F.col("id") % 12 * 1000)
    return r.select("id", width.alias("width"), numbers.shard_tokens(F.col("gib"), 0.8, 4.0, width, F.lit(1_000_000_000).cast("long")).alias("tokens"), numbers.tokens_per_step(F.lit(8), F.lit(2048), F.lit(16), F.col("n")).alias("step_tokens"))


_FILES = "f AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'model.safetensors' WHEN 1 THEN event_type || '_' || event_id || '.safetensors' WHEN 2 THEN 'step_' || event_id || '.pt' ELSE event_type || '.pt' END AS name, min(event_id) AS id FROM events GROUP BY ALL)"


@query(
    f"WITH {_FILES} SELECT user_id, name, 'layer.' || id AS bare, CAST(row_number() OVER (PARTITION BY user_id ORDER BY name = 'model.safetensors' DESC, name LIKE '%.safetensors' DESC, name) AS INT) AS place, CASE WHEN name LIKE 'step\\_%' ESCAPE '\\' THEN id END AS step FROM f"
)
def checkpoint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the files of a model, ranked, and their tensors' bare names."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.when(i % 4 == 0, "model.safetensors").when(i % 4 == 1, F.concat_ws("", kind, F.lit("_"), i, F.lit(".safetensors"))).when(i % 4 == 2, F.concat_ws("", F.lit("step_"), i, F.lit(".pt"))).otherwise(F.concat(kind, F.lit(".pt")))
    files = read(spark, sf_dir, "events").groupBy("user_id", name.alias("name")).agg(F.min("event_id").alias("id"))
    files = files.withColumn("key", F.concat_ws("", F.when(F.col("id") % 2 == 0, "module.").otherwise("_orig_mod."), F.lit("_orig_mod.layer."), "id"))
    ranked = evalkit.ranked_files(files, "model.safetensors", model="user_id")
    return ranked.select("user_id", "name", strip_prefixes("key", ["module.", "_orig_mod."], until_stable=True).alias("bare"), "place", step_number("name").alias("step"))


@query(
    "WITH r AS (SELECT max(event_id) AS step FROM events WHERE event_type = 'purchase'), c AS (SELECT max(event_id) AS step FROM events WHERE event_type = 'click')"
    " SELECT 'result' AS kind, 'eval_results_step_' || step || '.json' AS name, step FROM r UNION ALL SELECT 'checkpoint', 'step_' || step || '.pt', step FROM c"
)
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest result file and the checkpoint to resume from, among names that events leave."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.when(kind == "purchase", F.concat_ws("", F.lit("eval_results_step_"), i, F.lit(".json"))).when(kind == "click", F.concat_ws("", F.lit("step_"), i, F.lit(".pt"))).otherwise(F.concat(kind, F.lit(".log")))
    files = read(spark, sf_dir, "events").select(name.alias("name"))
    checkpoints = files.filter(F.col("name").endswith(".pt"))
    return evalkit.newest_result(files).select(F.lit("result").alias("kind"), "name", "step").unionByName(evalkit.newest_checkpoint(checkpoints).select(F.lit("checkpoint").alias("kind"), "name", "step"))


@query("SELECT page_id, substr(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 40) AS name, regexp_replace(url, '^(https?://)+', '') AS bare FROM pages WHERE url <> ''")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").filter("url <> ''")
    return p.select("page_id", file_name("url", 40).alias("name"), strip_prefixes("url", ["https://", "http://"], until_stable=True).alias("bare"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT user_id AS key, count(*) AS documents, CAST(sum(CASE WHEN before < 400 THEN 1 ELSE 0 END) AS BIGINT) AS admitted FROM (SELECT user_id, coalesce(sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) GROUP BY user_id")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's budgeted admission, drained: every event is a document of event_id % 100 tokens."""
    e = event_files(spark, sf_dir).withColumn("n", F.col("event_id") % 100)
    out = flows.drained(flows.admitted_stream(e, 400, source="user_id", order="event_id", tokens="n"))
    return out.groupBy("key").agg(F.count("*").alias("documents"), F.sum(F.col("admitted").cast("long")).alias("admitted"))


@query(f"{_EMA} SELECT user_id AS key, round(max_by(ema, r), 6) AS ema FROM m GROUP BY user_id")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.drained(flows.ema_stream(event_files(spark, sf_dir), run="user_id", order="event_id", value="value"))
    return out.groupBy("key").agg(F.round(F.max_by("ema", "order"), 6).alias("ema"))


@query("SELECT event_type, count(*) AS documents, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_files(spark, sf_dir).withColumn("n", F.col("event_id") % 100)
    return flows.drained(flows.totals_stream(e, source="event_type", tokens="n"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows over the events' stream."""
    events = event_files(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = flows.counted_windows(events, at="ts", kind="event_type", size="1 hour")
    return flows.drained(out, "complete")
