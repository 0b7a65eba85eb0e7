"""Readers, the manifest, ordered plans and streams."""

from __future__ import annotations

import gzip
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.operators import budget
from textmill.plans import ledger, manifest, ordered
from textmill.sources import mix, readers, tail
from textmill.streaming import flows


def test_running_sum_any_width(spark):
    rows = [(k, i * 3, (i * 7) % 11) for i in range(500) for k in "ab"]
    d = spark.createDataFrame(rows, "k string, o long, v long")
    for width, parts in ((10, 1), (64, 7), (10**9, 3)):
        got = {(r["k"], r["o"]): r["s"] for r in ordered.running_sum(d.repartition(parts), ["k"], "o", F.col("v"), "s", width=width).collect()}
        for k in "ab":
            total = 0
            for kk, o, v in rows:
                if kk == k:
                    assert got[k, o] == total
                    total += v


def test_running_sum_of_sparse_orders(spark):
    """Ids spread over the whole range of a long, a cluster far from zero and negative ones: few buckets, none of them large."""
    r = random.Random(2)
    orders = sorted({*(r.randrange(-(2**62), 2**62) for _ in range(20_000)), *range(3000), *(10**15 + i for i in range(3000))})
    d = spark.createDataFrame([(o, o % 7) for o in orders], "o long, v long").repartition(5)
    before, expected = 0, {}
    for o in orders:
        expected[o] = before
        before += o % 7
    got = ordered.running(d, [], "o", {"s": ordered.Running(F.col("v")), "m": ordered.running_min(F.col("o"))}, width=500)
    rows = got.collect()
    assert {x["o"]: x["s"] for x in rows} == expected
    assert {x["m"] for x in rows if x["o"] != orders[0]} == {orders[0]}
    sizes = ordered.bucketed(d, "o", 500).groupBy("_coarse", "_fine").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert sizes["most"] <= 3000 and sizes["n"] < 1000


def test_running_sum_keeps_nulls(spark):
    d = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 7), ("a", 1, 8)], "k string, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in ordered.running_sum(d, ["k"], "o", F.col("v"), "s").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", None): 0, ("a", 1): 7}


def test_hash_rank_is_a_permutation(spark):
    d = ordered.hash_rank(spark.range(1000), F.md5(F.col("id").cast("string").cast("binary")), "r", slices=16).collect()
    assert sorted(r["r"] for r in d) == list(range(1000)) and [r["r"] for r in sorted(d)] != list(range(1000))


def test_budget_edges(spark):
    docs = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("a", 2, 10), ("b", 0, 99), ("c", 0, 5)], "source_id string, seq long, n_tokens long")
    targets = spark.createDataFrame([("a", 20), ("b", 5), ("c", 0), ("empty", 7)], "source_id string, target long")
    assert {(r["source_id"], r["seq"]) for r in budget.take(docs, targets).collect()} == {("a", 0), ("a", 1), ("b", 0)}
    again = spark.createDataFrame([("a", 65), ("b", 1000)], "source_id string, target long")
    passes = {(r["source_id"], r["seq"]): r["passes"] for r in budget.cycle(docs, again, epochs=4).collect()}
    assert passes == {("a", 0): 3, ("a", 1): 2, ("a", 2): 2, ("b", 0): 4}


def test_targets_truncate_twice(spark):
    s = readers.descriptors(spark, [readers.Source("p", "x", 1.0), readers.Source("q", "x", 2.0), readers.Source("r", "y"), readers.Source("z", "none"), readers.Source("off", "x", enabled=False)])
    m = spark.createDataFrame([("x", 0.55), ("y", 0.3), ("w", 0.15)], "category string, fraction double")
    got = {r["source_id"]: r["target"] for r in mix.targets(readers.enabled(s), m, 101).collect()}
    assert got == {"p": 18, "q": 36, "r": 30}


def test_manifest(tmp_path):
    path = tmp_path / "m.json"
    one = manifest.commit(path, {}, {"id": 0, "actual_tokens": 5})
    two = manifest.commit(path, one, {"id": 1, "actual_tokens": 7})
    assert [(s["tokens_start"], s["tokens_end"]) for s in two["shards"]] == [(0, 5), (5, 12)] and two["tokens_prepared"] == 12
    with pytest.raises(manifest.Conflict):
        manifest.commit(path, one, {"id": 2, "actual_tokens": 1})
    assert list(tmp_path.iterdir()) == [path]


def test_writers_take_turns(tmp_path):
    import threading

    path, done = tmp_path / "m.json", []

    def add(k):
        while True:
            try:
                manifest.commit(path, manifest.read_json(path, {}) or {}, {"id": k, "actual_tokens": 3})
                done.append(k)
                return
            except manifest.Conflict:
                continue

    threads = [threading.Thread(target=add, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = manifest.read_json(path)
    assert found["tokens_prepared"] == 36 and len(found["shards"]) == 12 and len({s["tokens_start"] for s in found["shards"]}) == 12
    (tmp_path / "m.json.lock").touch()
    with pytest.raises(manifest.Conflict), manifest.locked(path, patience=0.1):
        pass
    with manifest.locked(path, patience=0.1, stale=-1):
        pass


def test_parts_of_shards(spark, tmp_path):
    root = str(tmp_path / "s")
    d = spark.createDataFrame([(m, i, 30 if i % 5 else 200) for i in range(40) for m in ("standard", "fim_psm")], "mode string, seq long, n_tokens long")
    manifest.write_shard(d, root, 3, most=100)
    got = spark.read.parquet(root)
    assert got.count() == 80
    parts = got.groupBy("mode", "part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.countDistinct(F.col("_metadata.file_path")).alias("files")).collect()
    assert all(r["files"] == 1 and (r["n"] <= 100 or r["rows"] == 1) for r in parts)
    files = manifest.shard_files(root, 3)
    assert len(files) == len(parts) and {f["mode"] for f in files} == {"standard", "fim_psm"}


def test_log(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    for i in range(100):
        manifest.append_line(path, {"i": i}, most_bytes=200)
    last = lambda most=1 << 20: [r["i"] for r in tail.tail_objects(spark, str(path), "i int", most).collect()]
    rows = last()
    assert path.stat().st_size <= 200 and rows == list(range(rows[0], 100))
    with path.open("a") as f:
        f.write("bad\n\n[1]\n")
    assert last()[-1] == 99 and last(30) == [98, 99] and not list(tmp_path.glob("*.tmp"))


def test_end_of_a_large_log_is_read_from_its_end(spark, tmp_path):
    path = tmp_path / "big.log"
    with path.open("wb") as f:
        f.truncate(1 << 30)  # a gigabyte that takes no room
        f.seek(1 << 30)
        f.write(b"".join(b"\nline %07d %s" % (i, b"x" * (i % 90)) for i in range(40_000)) + b"\n")
    ranges = tail.TailReader(str(path), 1 << 20).partitions()
    assert len(ranges) > 3 and sum(r.end - r.begin for r in ranges) == 1 << 20
    data = path.open("rb")
    data.seek(-(1 << 20), 2)
    lines = data.read().decode().split("\n")[1:-1]
    found = tail.tail_lines(spark, str(path)).orderBy("at").collect()
    assert [r["value"] for r in found] == lines
    size = path.stat().st_size
    assert found[-1]["at"] + len(lines[-1]) + 1 == size
    assert [r["value"] for r in tail.last_lines(spark, str(path), 20_000, skip="5 ").collect()] == [x for x in (f"line {i:07d} {'x' * (i % 90)}" for i in range(40_000)) if "5 " not in x][-20_000:]


def test_files_of_a_folder_are_one_log(spark, tmp_path):
    for name, text in (("a.log", "1\n2\n"), ("b.log", ""), ("c.log", "3\n\n4")):
        (tmp_path / name).write_text(text)
    lines = lambda n: [r["value"] for r in tail.tail_lines(spark, str(tmp_path), n).orderBy("file", "at").collect()]
    assert lines(100) == ["1", "2", "3", "", "4"] and lines(6) == ["3", "", "4"] and lines(3) == ["", "4"] and lines(1) == []
    assert [r["value"] for r in tail.last_lines(spark, str(tmp_path), 3, first_bytes=1).collect()] == ["2", "3", "4"]
    assert tail.tail_lines(spark, str(tmp_path / "none")).collect() == []
    small = tmp_path / "long"
    small.mkdir()
    (small / "x").write_text("y" * 700_000 + "\n" + "z" * 300 + "\nend")
    assert [len(r["value"]) for r in tail.tail_lines(spark, str(small)).orderBy("at").collect()] == [700_000, 300, 3]


def test_ledger_gives_way_to_the_first_writer(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    one, two = ledger.Ledger(spark, root, keep=3), ledger.Ledger(spark, root, keep=3)
    assert one.read() == (0, {})
    seen, state = two.read()
    one.commit(0, ledger.with_shard({}, {"id": 0, "actual_tokens": 7}))
    with pytest.raises(manifest.Conflict):
        two.commit(seen, ledger.with_shard(state, {"id": 1, "actual_tokens": 1}))
    two.change(lambda s: ledger.with_shard(s, {"id": 1, "actual_tokens": 5}))
    number, state = one.read()
    assert number == 2 and [(x["tokens_start"], x["tokens_end"]) for x in state["shards"]] == [(0, 7), (7, 12)] and state["tokens_prepared"] == 12


def test_writers_race_for_the_ledger(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/ledger"

    def work(writer):
        own = ledger.Ledger(spark, root, keep=3)
        for k in range(6):
            own.change(lambda s, k=k: ledger.with_shard(s, {"id": f"{writer}-{k}", "actual_tokens": 1}))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    number, state = ledger.Ledger(spark, root).read()
    assert number == 24 and {x["id"] for x in state["shards"]} == {f"{w}-{k}" for w in range(4) for k in range(6)}
    assert [x["tokens_start"] for x in state["shards"]] == list(range(24))
    assert len(list((tmp_path / "ledger").glob("*.json"))) <= 4 and not list((tmp_path / "ledger").glob(".*.new"))


def test_delete_below(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    manifest.delete_below(tmp_path, tmp_path / "a")
    assert not (tmp_path / "a").exists()
    for bad in (tmp_path, tmp_path / "..", tmp_path / "x" / ".." / ".."):
        with pytest.raises(ValueError):
            manifest.delete_below(tmp_path, bad)


def test_shards_are_replaced_alone(spark, tmp_path):
    root = str(tmp_path / "s")
    d = spark.createDataFrame([("standard", 1), ("fim_psm", 2)], "mode string, x int")
    manifest.write_shard(d, root, 0)
    manifest.write_shard(d, root, 1)
    manifest.write_shard(d.limit(1), root, 1)
    assert spark.read.parquet(root).filter("shard_id = 0").count() == 2


def test_arrow_source(spark, tmp_path):
    for name, make in (("train-1.arrow", pa.ipc.new_stream), ("train-2.arrow", pa.ipc.new_file)):
        t = pa.table({"x": [1, 2], "y": ["a", None]})
        with pa.OSFile(str(tmp_path / name), "wb") as f, make(f, t.schema) as w:
            w.write_table(t)
    (tmp_path / "test-1.arrow").write_bytes(b"")
    got = readers.scan(spark, readers.Source("s", "c", format="arrow", path=str(tmp_path), split="train[:9]"))
    assert sorted(r["x"] for r in got.collect()) == [1, 1, 2, 2]
    with pytest.raises(FileNotFoundError):
        readers.arrow_files(f"{tmp_path}/none*")


def test_text_and_json_sources(spark, tmp_path):
    log = tmp_path / "l.jsonl"
    log.write_text('{"a": 1}\nbad\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(log), "a int").collect()) == [1, 2]
    assert [r["value"] for r in tail.last_lines(spark, str(log), 2, skip="bad").collect()] == ['{"a": 1}', '{"a": 2}']
    (tmp_path / "g.json").write_text(json.dumps([["x", "y"], ["z"]]))
    assert sorted(map(tuple, readers.generations(spark, str(tmp_path / "g.json"), 5).collect())) == [(5, 0, "x"), (5, 1, "y"), (6, 0, "z")]
    (tmp_path / "d.json").write_text(json.dumps({"k": {"v": 1}}, indent=1))
    assert readers.json_document(spark, str(tmp_path / "d.json")).first()["k"]["v"] == 1


def test_bundles(spark, tmp_path):
    for name, data in (("b1.gz", gzip.compress("é".encode())), ("b2.gz", b"broken"), ("b3.gz", gzip.compress(b"c"))):
        (tmp_path / name).write_bytes(data)
    blobs = readers.gunzipped(spark, str(tmp_path))
    kind = "files array<struct<path:string,language:string,blob_id:string,src_encoding:string,is_vendor:boolean,is_generated:boolean>>"
    raw = spark.createDataFrame([([("a.py", "Python", "b1", None, None, False), ("v.py", "Python", "b3", None, True, None), ("b.rs", "Rust", "b3", None, False, False), ("x.py", "python", "b2", None, False, False)],)], kind)
    got = readers.bundles(raw, blobs, readers.Source("s", "code", languages=("Python",))).collect()
    assert [(r["path"], r["text"]) for r in got] == [("a.py", "é")]


def test_documents_and_access(spark):
    raw = spark.createDataFrame([("t", None, "p", "en")], "title string, body string, path string, lang string")
    d = readers.documents(raw, readers.Source("s", "c", text_fields=("title", "body"), path_field="path")).first()
    assert (d["text"], d["path"], d["language"]) == ("t", "p", "en")
    s = readers.Source("s", "c", path="org/gated")
    assert readers.missing_access(s, ["org/gated"], False, True) and readers.missing_access(s, ["org/gated"], True, False) is None
    assert readers.missing_access(readers.Source("s", "c", path="s3://b/x"), [], True, False)


def test_configured_source(spark, tmp_path):
    for name, n in (("train-0", 3), ("train-1", 2), ("test-0", 9)):
        spark.range(n).coalesce(1).write.json(str(tmp_path / "set" / "py" / f"{name}.json"))
    source = {"id": "s", "dataset": str(tmp_path / "set"), "data_dir": "py", "hf_token": "secret"}
    assert readers.configured(spark, source, {}, {}, format="json").count() == 5
    assert readers.configured(spark, source | {"split": "test[:10%]"}, {}, {}, format="json").count() == 9
    assert readers.configured(spark, source | {"data_files": ["train-1.json", "test-0.json"]}, {}, {}, format="json").count() == 11
    assert readers.configured(spark, source | {"data_files": {"train": "train-0.json"}}, {}, {}, format="json").count() == 3
    assert readers.configured(spark, {"dataset": str(tmp_path / "set"), "name": "py"}, {}, {}, format="json").count() == 5
    with pytest.raises(ValueError, match="no files for split"):
        readers.configured(spark, source | {"split": "x", "data_files": {"train": "a"}}, {}, {}, format="json")


def test_fallback_source(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "ok"))
    got = readers.scan_either(spark, readers.Source("a", "c", path=str(tmp_path / "none")), readers.Source("b", "c", path=str(tmp_path / "ok")))
    assert got.count() == 3


def test_stream_resumes(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "id % 2 AS k").coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(str(src))
        q = s.writeStream.foreachBatch(flows.committed_once(str(out))).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(out / "batches"))
    assert got.count() == 30 and got.select("id").distinct().count() == 30 and got.select("batch_id").distinct().count() == 3


def test_encodings_of_blobs(spark):
    kind = "files array<struct<path:string,language:string,blob_id:string,src_encoding:string,is_vendor:boolean,is_generated:boolean>>"
    contents = {"1": (b"caf\xc3\xa9", None), "2": (b"caf\xe9", "latin-1"), "3": (b"a\xffb", "UTF-8"), "4": ("é".encode("utf-16"), "utf-16"), "5": (b"x", "no-such")}
    raw = spark.createDataFrame([([(k, "Python", k, e, None, None) for k, (_, e) in contents.items()],)], kind)
    blobs = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in contents.items()], "blob_id string, content binary")
    got = {r["path"]: r["text"] for r in readers.bundles(raw, blobs, readers.Source("s", "code")).collect()}
    assert got == {"1": "café", "2": "café", "3": "a\ufffdb", "4": "é", "5": None}


def test_item_text(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, text string")
    assert readers.item_text(items, 2) == "b"
    with pytest.raises(KeyError):
        readers.item_text(items, 3)


def test_streams_of_sources_resume_and_retry(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "root")
    for i in range(2):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(str(src))
    s = readers.Source("s", "c", path=str(src))
    assert flows.drained(flows.source_stream(spark, s, "id long"), root=root).count() == 10
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(str(src))
    got = flows.drained(flows.source_stream(spark, s, "id long"), root=root)
    assert sorted(r[0] for r in got.collect()) == list(range(12))
    calls, waits = [], []

    def start():
        def write(batch, number):
            calls.append(number)
            if len(calls) < 3:
                raise OSError("gone")

        return flows.source_stream(spark, s, "id long").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()

    assert flows.retried(start, wait=waits.append) == 2 and waits == [1.0, 2.0]
    spark.range(9).coalesce(1).write.mode("append").parquet(str(src))

    def never():
        def write(batch, number):
            raise OSError("gone")

        return flows.source_stream(spark, s, "id long").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()

    with pytest.raises(flows.Unreadable):
        flows.retried(never, most=1, wait=waits.append)


def test_bounded_time_and_head():
    import subprocess

    code, text = manifest.run_bounded(["python", "-c", "print('begin' + 'x' * 100000)"], 50, head=True)
    assert code == 0 and len(text) == 50 and text.startswith("begin")
    with pytest.raises(subprocess.TimeoutExpired):
        manifest.run_bounded(["python", "-c", "import time; time.sleep(60)"], 50, timeout=1.0)


def test_bounded_output():
    code, text = manifest.run_bounded(["python", "-c", "print('x' * 100000 + 'end'); raise SystemExit(3)"], 50)
    assert code == 3 and len(text) == 50 and text.endswith("end\n")


def test_shard_stats_file(spark, tmp_path):
    samples = spark.createDataFrame([("standard", 0, 5), ("standard", 1, 7), ("fim_psm", 0, 3)], "mode string, part int, n_tokens long")
    docs = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 0, 6])], "source_id string, seq long, n_tokens long")
    taken = budget.cycle(docs, spark.createDataFrame([("a", 25)], "source_id string, target long"))
    stats = budget.source_stats(docs, taken, spark.createDataFrame([("a", 1, 2)], "source_id string, epoch long, offset long"), spark.createDataFrame([("a", 4)], "source_id string, stream_retries long"))
    told = manifest.write_shard_stats(tmp_path / "shard_stats.json", budget.mode_stats(samples), stats)
    assert told == manifest.read_json(tmp_path / "shard_stats.json")
    assert (told["actual_tokens"], told["files"], told["mode_docs"]) == (15, 3, {"standard": 2, "fim_psm": 1})
    # 4, 0, 6 | 4, 0, 6 | 4, 0, 6: the third pass begins at 20 tokens, its last document has 24 before it
    assert told["source_stats"]["a"] == {"target_tokens": 25, "actual_tokens": 30, "documents": 6, "examples_consumed": 9, "epochs_completed": 3, "offset": 2, "epoch": 4, "stream_retries": 4}


def test_options_and_access():
    from textmill.operators import chunk

    source = {"name": "en", "config_name": "", "data_files": "x*", "trust_remote_code": 0}
    assert readers.reader_options(source, {"data": {"hf_token": "t"}}, {"HF_TOKEN": "u"}) == {"name": "en", "data_files": "x*", "token": "t"}
    assert readers.reader_options({"hf_token": "own"}, {}, {"HF_TOKEN": "u"}) == {"token": "own"} and readers.reader_options({}, {}, {}) == {}
    s = [readers.Source("g", "c", path="org/gated"), readers.Source("b", "c", path="s3://b/x")]
    with pytest.raises(PermissionError, match="g: .*; b: "):
        readers.check_access(s, ["org/gated"], {})
    readers.check_access(s, ["org/gated"], {"HF_TOKEN": "t", "AWS_PROFILE": "p"})
    assert chunk.merged({"min_chars": 5, "classes": True}, {"min_chars": 9}) == chunk.Chunking(min_chars=9, classes=True)
    with pytest.raises(TypeError):
        chunk.merged({}, {"no_such": 1})


def test_windows_of_a_folder(spark, tmp_path):
    from textmill.operators import pack

    spark.createDataFrame([("standard", i, list(range(i, i + 7))) for i in range(20)], "mode string, seq long, tokens array<int>").write.parquet(str(tmp_path / "t"))
    one, two = ({r["place"]: r["window"] for r in pack.scan_windows(spark, str(tmp_path / "t"), 10, seed).collect()} for seed in (1, 2))
    assert sorted(one.values()) == sorted(two.values()) == list(range(14)) and one != two
    assert "positions" not in pack.scan_windows(spark, str(tmp_path / "t"), 10, 1, with_positions=False).columns


def test_rejections(spark):
    from textmill.operators import sft

    d = spark.createDataFrame([("s", i, i % 4 == 0) for i in range(20)], "source_id string, seq long, ok boolean")
    sft.check_rejections(d, F.col("ok"), source="source_id", order="seq", most=4)
    with pytest.raises(ValueError, match="3 unusable"):
        sft.check_rejections(d, F.col("ok"), source="source_id", order="seq", most=3)
