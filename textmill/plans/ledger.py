"""The manifest in the folder that all drivers share: numbered states, each created once.

State number n is the file n.json.  A commit writes a new file of its own and gives it the next number,
which fails if another commit has taken it: that is Conflict, and nothing has changed.  The highest number
is the state.  No lock, and nothing on any driver's own disk.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from textmill.plans.manifest import Conflict
from textmill.plans.shared import file_system


class Ledger:
    def __init__(self, spark: SparkSession, root: str, keep: int = 20):
        """root: a folder by URI; keep: how many states before the last one stay for readers that are behind."""
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.system, self.folder = file_system(spark, self.root)
        self.system.mkdirs(self.folder)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self.system.listStatus(self.folder)]
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", x) for x in names) if m)

    def read(self) -> tuple[int, dict]:
        """Number and state; 0 and an empty state where nothing has been committed."""
        while numbers := self._numbers():
            try:
                stream = self.system.open(self._path(f"{numbers[-1]:012d}.json"))
            except Py4JJavaError:
                continue  # it has been cleared away meanwhile, as there are newer ones
            try:
                return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return 0, {}

    def commit(self, seen: int, state: dict) -> int:
        """Makes `state` the one after number `seen`; Conflict if there is one already."""
        jvm, number = self.spark.sparkContext._jvm, seen + 1
        if self._numbers()[-1:] > [seen]:
            raise Conflict(f"{self.root} has states after {seen}")
        own, final = self._path(f".{uuid.uuid4().hex}.new"), self._path(f"{number:012d}.json")
        stream = self.system.create(own, False)
        try:
            stream.write(bytearray((json.dumps(state, sort_keys=True, ensure_ascii=False) + "\n").encode()))
        finally:
            stream.close()
        try:
            if self.folder.toUri().getScheme() in (None, "file"):
                # on a plain disk a link is what only one of two can make
                files, local = jvm.java.nio.file.Files, lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create("file://" + p.toUri().getPath()))
                files.createLink(local(final), local(own))
            else:
                none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(own, final, options)
        except (Py4JJavaError, PySparkException) as error:
            if self.system.exists(final):
                raise Conflict(f"{self.root} has state {number} already") from error
            raise
        finally:
            self.system.delete(own, False)
        for old in self._numbers()[: -self.keep - 1]:
            self.system.delete(self._path(f"{old:012d}.json"), False)
        return number

    def change(self, by: Callable[[dict], dict], tries: int = 50) -> dict:
        """Commits by(state), and does so anew with the newer state where another writer was first."""
        for _ in range(tries):
            number, state = self.read()
            changed = by(state)
            try:
                self.commit(number, changed)
                return changed
            except Conflict:
                continue
        raise Conflict(f"{self.root}: {tries} commits of others came first")


def with_shard(state: dict, shard: dict) -> dict:
    """The manifest with one more shard, whose tokens begin where the last one's end."""
    start = state.get("tokens_prepared", 0)
    shard = shard | {"tokens_start": start, "tokens_end": start + shard["actual_tokens"], "status": "built"}
    return state | {"tokens_prepared": shard["tokens_end"], "shards": [*state.get("shards", []), shard]}
