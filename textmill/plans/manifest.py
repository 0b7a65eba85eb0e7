"""The shards' manifest: atomic files, compare-and-swap commits, status events, retention.

Tables hold what grows (shards, statistics, status events); the manifest itself is one small document
that a single driver commits.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.plans.ordered import running_sum


class Conflict(RuntimeError):
    """The manifest changed between reading and committing."""


def write_json(path: str | os.PathLike, data: object) -> None:
    """Readers see the old document or the new one, never a part."""
    _replace(Path(path), (json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def _replace(path: Path, content: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("wb", dir=path.parent, prefix=path.name, suffix=".tmp", delete=False) as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def read_json(path: str | os.PathLike, default: object = None) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def append_line(path: str | os.PathLike, row: dict, most_bytes: int = 1 << 20) -> None:
    """Appends to a JSON lines log; over the limit, whole lines go from its beginning, in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False) + "\n")
    if path.stat().st_size > most_bytes:
        tail = path.read_bytes()[-most_bytes:]
        _replace(path, tail[tail.find(b"\n") + 1 :])


@contextlib.contextmanager
def locked(path: str | os.PathLike, patience: float = 30.0, stale: float = 600.0) -> Iterator[None]:
    """Holds a lock file beside a document, so that reading and writing it are one step for all writers.

    A lock older than `stale` seconds is its owner's remains and is taken over.
    """
    lock = Path(f"{path}.lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    until = time.monotonic() + patience
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            with contextlib.suppress(FileNotFoundError):
                if time.time() - lock.stat().st_mtime > stale:
                    lock.unlink(missing_ok=True)
                    continue
            if time.monotonic() > until:
                raise Conflict(f"{lock} is held by another writer") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def commit(path: str | os.PathLike, seen: dict, shard: dict) -> dict:
    """Adds a shard to the manifest that `seen` was read from; Conflict if another commit came between."""
    with locked(path):
        now = read_json(path, {}) or {}
        if (now.get("tokens_prepared", 0), len(now.get("shards", []))) != (seen.get("tokens_prepared", 0), len(seen.get("shards", []))):
            raise Conflict(f"{path} changed since it was read")
        start = now.get("tokens_prepared", 0)
        shard = shard | {"tokens_start": start, "tokens_end": start + shard["actual_tokens"], "status": "built"}
        now = now | {"tokens_prepared": shard["tokens_end"], "shards": [*now.get("shards", []), shard]}
        write_json(path, now)
        return now


def current_status(events: DataFrame, *, shard: str = "shard_id", status: str = "status", at: str = "at") -> DataFrame:
    return events.groupBy(shard).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))


def next_shard(current: DataFrame) -> DataFrame:
    """The first shard that is built or in training."""
    return current.filter(F.col("status").isin("built", "training")).orderBy("shard_id").limit(1)


def waiting(current: DataFrame) -> DataFrame:
    return current.agg(F.count_if(F.col("status").isin("built", "training")).alias("waiting"))


def superfluous(files: DataFrame, keep: int, *, name: str = "name", slots: list[str] | None = None) -> DataFrame:
    """Checkpoints beyond the newest `keep` by zero-padded name; named slots are never among them."""
    plain = files.filter(~F.col(name).isin(*slots)) if slots else files
    newest = plain.select(F.col(name).alias("_kept")).orderBy(F.desc("_kept")).limit(keep)  # a top-k, not a sort of all
    return plain.join(F.broadcast(newest), F.col(name) == F.col("_kept"), "left_anti")


def newest_within(rows: DataFrame, most_bytes: int, *, order: str, text: str) -> DataFrame:
    """The newest log rows whose lines fit the limit; order: a number."""
    size = F.octet_length(text).cast("long") + 1
    before = running_sum(rows.withColumn("_newest", -F.col(order)), [], "_newest", size, "_before")
    return before.filter(F.col("_before") + size <= most_bytes).drop("_before", "_newest")


def spans(shards: DataFrame) -> DataFrame:
    """Adds tokens_start and tokens_end; one row a shard."""
    out = running_sum(shards, [], "id", F.col("actual_tokens"), "tokens_start")
    return out.withColumns({"tokens_start": F.col("tokens_start").cast("long"), "tokens_end": (F.col("tokens_start") + F.col("actual_tokens")).cast("long")})


def write_shard(samples: DataFrame, root: str, shard_id: int, *, most: int | None = None, order: str = "seq", tokens: str = "n_tokens") -> None:
    """A shard's samples by mode; writing it again replaces it alone.

    With `most`, a mode's samples go into parts of at most so many tokens, in order (see `pack.part_roll`),
    one file each: a sample that doesn't fit opens the next part, one that is larger has its own.
    """
    from textmill.operators.pack import part_roll

    rows = samples.withColumn("shard_id", F.lit(shard_id))
    by = ["shard_id", "mode"]
    if most is not None:
        rows = rows.join(part_roll(rows, most, order=order, tokens=tokens).select("mode", order, "part"), ["mode", order])
        by = [*by, "part"]
        rows = rows.repartition(*by).sortWithinPartitions(*by, order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def write_shard_stats(path: str | os.PathLike, modes: DataFrame, sources: DataFrame) -> dict:
    """The stats file beside a shard: totals by mode, and by source.  Both tables have a row for each of the configuration's."""
    by_mode = {r["mode"]: r.asDict() for r in modes.collect()}
    by_source = {r["source_id"]: {k: v for k, v in r.asDict().items() if k != "source_id"} for r in sources.collect()}
    stats = {
        "actual_tokens": sum(r["tokens"] for r in by_mode.values()),
        "files": sum(r["files"] for r in by_mode.values()),
        "mode_tokens": {k: r["tokens"] for k, r in by_mode.items()},
        "mode_docs": {k: r["samples"] for k, r in by_mode.items()},
        "source_stats": by_source,
    }
    write_json(path, stats)
    return stats


def shard_files(root: str, shard_id: int) -> list[dict]:
    """mode, part, path, of a shard's files, as they are listed in the folder of its id."""
    out = []
    for path in sorted(Path(root.removeprefix("file://")).glob(f"shard_id={shard_id}/mode=*/**/*.parquet")):
        names = dict(x.split("=", 1) for x in path.parts if "=" in x)
        out.append({"mode": names["mode"], "part": int(names.get("part", 0)), "path": str(path)})
    return out


def delete_below(root: str | os.PathLike, path: str | os.PathLike) -> None:
    """Deletes a folder under root; root itself and anything outside is refused."""
    root, path = Path(root).resolve(), Path(path).resolve()
    if path == root or root not in path.parents:
        raise ValueError(f"{path} is not below {root}")
    shutil.rmtree(path, ignore_errors=True)


def run_bounded(command: list[str], most_bytes: int = 65_536, timeout: float | None = None, head: bool = False) -> tuple[int, str]:
    """Runs a command and keeps the last bytes of what it prints, or with `head` the first: (return code, text).

    A command that runs longer than `timeout` seconds is ended, whether it prints or not, and raises
    subprocess.TimeoutExpired.
    """
    import subprocess
    import threading
    from collections import deque

    kept: deque[bytes] = deque()
    held, late = 0, threading.Event()
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT) as p:
        alarm = threading.Timer(timeout, lambda: (late.set(), p.kill())) if timeout else None
        if alarm:
            alarm.start()
        try:
            for part in iter(lambda: p.stdout.read1(8192), b""):
                if head and held >= most_bytes:
                    continue
                kept.append(part)
                held += len(part)
                while not head and held - len(kept[0]) >= most_bytes:
                    held -= len(kept.popleft())
            code = p.wait()
        finally:
            if alarm:
                alarm.cancel()
    if late.is_set():
        raise subprocess.TimeoutExpired(command, timeout)
    text = b"".join(kept)
    return code, (text[:most_bytes] if head else text[-most_bytes:]).decode("utf-8", "replace")
