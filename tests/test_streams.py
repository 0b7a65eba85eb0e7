"""Streams that resume at a row, keyed state, listeners, sessions, joins and logs."""

from __future__ import annotations

import json
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from textmill.streaming import books, corpus, flows, listen

N = 230


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three files, one of them with several row groups."""
    path = str(tmp_path_factory.mktemp("corpus") / "t")
    rows = [(i, f"s{i % 3}", None if i % 11 == 0 else "x " * (i % 7)) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    for part in (df.filter("id < 60"), df.filter("id BETWEEN 60 AND 199"), df.filter("id >= 200")):
        part.coalesce(1).write.option("parquet.block.size", 1024).mode("append").parquet(path)
    return path


def stream(spark, table, root, **options):
    tokens = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), ""))
    return corpus.corpus_stream(spark, table, ["id", "source", "text"], root=str(root), tokens=tokens, slice_rows=25, **options)


def test_each_row_of_two_epochs_once_though_killed(spark, table, tmp_path):
    root = str(tmp_path)

    def failing(batch, number):
        if number == 2:
            raise RuntimeError("killed")
        flows.committed_once(root)(batch, number)

    source = stream(spark, table, root, epochs=2, seed=9, batch_tokens=150)
    query = source.writeStream.foreachBatch(failing).trigger(processingTime="0 seconds").option("checkpointLocation", f"{root}/checkpoint").start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(120)
    rows = corpus.exhausted(stream(spark, table, root, epochs=2, seed=9, batch_tokens=150), root).collect()
    assert Counter((r.epoch, r.id) for r in rows) == Counter((e, i) for e in range(2) for i in range(N))
    assert sorted((r.epoch, r.place) for r in rows) == [(e, i) for e in range(2) for i in range(N)]
    order = [[r.id for r in sorted((r for r in rows if r.epoch == e), key=lambda r: r.place)] for e in range(2)]
    assert order[0] != order[1] and order[0] != sorted(order[0])
    sizes = Counter()
    for r in rows:
        sizes[r.batch_id] += len((r.text or "").split())
    assert len(sizes) >= 6 and all(n >= 150 for k, n in sizes.items() if k != max(sizes))
    # nothing is left for another run
    assert corpus.exhausted(stream(spark, table, root, epochs=2, seed=9, batch_tokens=150), root).count() == 2 * N


def test_begins_after_skipped_rows(spark, table, tmp_path):
    found = corpus.exhausted(stream(spark, table, tmp_path / "a", skip=33), str(tmp_path / "a")).collect()
    assert sorted(r.place for r in found) == list(range(33, N)) and len({r.id for r in found}) == N - 33
    whole = corpus.exhausted(stream(spark, table, tmp_path / "b", epochs=3, skip=N + 5), str(tmp_path / "b"))
    assert whole.groupBy("epoch").count().collect() and {r.epoch: r["count"] for r in whole.groupBy("epoch").count().collect()} == {1: N - 5, 2: N}


def test_waits_for_consumed_batches(spark, table, tmp_path):
    root = str(tmp_path)
    make = lambda: stream(spark, table, root, batch_tokens=100, most_waiting=2)
    corpus.exhausted(make(), root)
    assert corpus.unconsumed(f"{root}/batches") == [0, 1]
    for k in (0, 1):
        corpus.consume(f"{root}/batches", k)
    corpus.exhausted(make(), root)
    assert corpus.unconsumed(f"{root}/batches") == [2, 3]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "id long, source string, text string").write.parquet(path)
    assert corpus.exhausted(stream(spark, path, tmp_path / "r"), str(tmp_path / "r")).count() == 0


def test_books_after_batches_and_a_restart(spark, table, tmp_path):
    def run(epochs):
        rows = stream(spark, table, tmp_path, epochs=epochs, batch_tokens=130)
        rows = rows.select("source", "id", F.size(F.array_remove(F.split("text", " "), "")).alias("n"), F.when(F.col("text").isNull(), "null").when(F.col("text") == "", "blank").alias("error")).withColumn("kept", F.col("error").isNull() & (F.col("id") % 2 == 0))
        return corpus.exhausted(books.source_books(rows, source="source", order="id", tokens="n", kept="kept", error="error"), str(tmp_path), mode="update")

    run(1)
    found = run(2)  # the state goes on
    assert found.select("batch_id").distinct().count() > 3
    last = {}
    for r in sorted(found.collect(), key=lambda r: r.batch_id):
        last[r.source] = (r.tokens, r.documents, r.examples, r.errors, dict(r.kinds))
    expected = {}
    for s in range(3):
        own = [(i, i % 11 == 0, i % 7) for i in range(N) if i % 3 == s]
        kinds = Counter("null" if null else "blank" for _, null, n in own if null or not n)
        kept = [n for i, null, n in own if not null and n and i % 2 == 0]
        expected[f"s{s}"] = (2 * sum(kept), 2 * len(kept), 2 * len(own), 2 * sum(kinds.values()), {k: 2 * n for k, n in kinds.items()})
    assert last == expected


def test_idle_sources_are_told(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    schema = "source string, id long, n long, kept boolean, error string"
    spark.createDataFrame([("a", 1, 5, True, None), ("a", 2, 0, False, "bad")], schema).write.parquet(str(source))
    rows = books.source_books(spark.readStream.schema(schema).parquet(str(source)), source="source", order="id", tokens="n", kept="kept", error="error", idle_ms=500)
    query = rows.writeStream.foreachBatch(flows.committed_once(root)).outputMode("update").option("checkpointLocation", f"{root}/c").trigger(processingTime="200 milliseconds").start()
    try:
        until, found = time.monotonic() + 60, []
        while time.monotonic() < until and not any(r.idle for r in found):
            time.sleep(0.3)
            if (tmp_path / "out" / "batches").exists():
                found = spark.read.schema(f"{books.BOOKS}, batch_id long").parquet(f"{root}/batches").collect()
    finally:
        query.stop()
    assert {(r.source, r.tokens, r.errors, r.failing, r.idle) for r in found} == {("a", 5, 1, 1, False), ("a", 5, 1, 1, True)}


def test_watchdog_and_waiting_for_a_shard(spark, table, tmp_path):
    progress = listen.listening(spark)
    try:
        empty = tmp_path / "empty"
        empty.mkdir()
        start = lambda df, name, f: df.writeStream.foreachBatch(f).trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / name)).start()
        idle = start(spark.readStream.schema("id long").parquet(str(empty)), "c1", lambda batch, number: None)
        with pytest.raises(flows.Stalled):
            listen.watch(idle, progress, longest_s=1.5)
        # stalled: built here
        idle = start(spark.readStream.schema("id long").parquet(str(empty)), "c2", lambda batch, number: None)
        assert listen.next_shard(lambda: None, lambda: "own", idle, progress, longest_s=1.5, poll_s=0.2) == ("own", True)
        assert not idle.isActive

        def broken(batch, number):
            raise RuntimeError("no disk")

        failing = start(spark.readStream.schema("id long, source string, text string").parquet(table), "c3", broken)
        assert listen.next_shard(lambda: None, lambda: "own", failing, progress, longest_s=60, poll_s=0.2) == ("own", True)
        with pytest.raises(StreamingQueryException):
            listen.watch(failing, progress, longest_s=60)
        assert "no disk" in progress.of(failing).error
        assert listen.next_shard(lambda: None, lambda: "own", None, progress) == ("own", True)
        made = []
        good = start(spark.readStream.schema("id long, source string, text string").parquet(table), "c4", lambda batch, number: made.append(batch.count()))
        assert listen.next_shard(lambda: sum(made) or None, lambda: "own", good, progress, longest_s=60, poll_s=0.2) == (N, False)
        good.processAllAvailable()
        good.stop()
        until = time.monotonic() + 20
        while progress.of(good).rows < N and time.monotonic() < until:
            time.sleep(0.1)
        assert progress.of(good).rows == N
    finally:
        spark.streams.removeListener(progress)


def test_late_rows_are_dropped_and_told(spark, tmp_path):
    source, begin = tmp_path / "in", datetime(2024, 1, 1)
    schema = "user long, at timestamp"
    steps = [[(1, 0), (1, 20), (2, 5)], [(1, 200), (2, 210)], [(1, 40), (2, 215)], [(3, 600)], [(3, 601)]]
    progress = listen.listening(spark)
    try:
        for i, rows in enumerate(steps):
            spark.createDataFrame([(u, begin + timedelta(minutes=m)) for u, m in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
            events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            found = flows.drained(flows.sessions(events, at="at", key="user"), root=str(tmp_path / "out"))
        minutes = sorted((r.user, (r.start - begin).seconds // 60, (r.end - begin).seconds // 60, r.n) for r in found.collect())
        # the row at minute 40 came after the watermark of minute 200 and is in no session
        assert minutes == [(1, 0, 50, 2), (1, 200, 230, 1), (2, 5, 35, 1), (2, 210, 245, 2)]
        until = time.monotonic() + 20
        while not any(s.late_rows for s in progress.queries.values()) and time.monotonic() < until:
            time.sleep(0.1)
        assert sum(s.late_rows for s in progress.queries.values()) == 1
    finally:
        spark.streams.removeListener(progress)


def test_streams_joined_within_an_interval(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    for name, rows in (("a", [(1, 0), (1, 100), (2, 0)]), ("b", [(1, 30), (1, 61), (1, 100), (2, 59), (3, 1)])):
        spark.createDataFrame([(u, begin + timedelta(minutes=m), m) for u, m in rows], "user long, at timestamp, m int").write.parquet(str(tmp_path / name))
    one, two = (spark.readStream.schema("user long, at timestamp, m int").parquet(str(tmp_path / x)) for x in "ab")
    found = flows.drained(flows.paired(one, two, key="user", at="at"))
    assert sorted((r.user, r.m, r.next_m) for r in found.collect()) == [(1, 0, 30), (1, 100, 100), (2, 0, 59)]


def test_last_of_each_kind_in_a_growing_log(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    seen = []
    for i, lines in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 1, "x"), ("a", 5, "z"), ("c", 3, "w")], [("a", 4, "late"), ("b", 2, "y")])):
        seen += lines
        (log / f"{i}.jsonl").write_text("\n".join([*(json.dumps({"kind": k, "step": s, "v": v}) for k, s, v in lines), "{broken", ""]))
        events = flows.json_log(spark, str(log), "kind string, step long, v string").filter("kind IS NOT NULL")
        found = flows.upserted(flows.latest_stream(events, kind="kind", order="step"), root, "kind")
        last = {}
        for k, s, v in seen:
            if k not in last or s > last[k][0]:
                last[k] = (s, v)
        assert {r.kind: (r.step, r.v) for r in found.collect()} == last
