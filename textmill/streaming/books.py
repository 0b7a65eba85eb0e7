"""Books of a stream's sources in keyed state: tokens, documents, examples, errors, failures in a row, idle sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with values, maps and timers is kept by this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOOKS = "source string, tokens long, documents long, examples long, errors long, failing long, kinds map<string, long>, idle boolean"
_ZERO = (0, 0, 0, 0, 0)


class SourceBooks(StatefulProcessor):
    """One value of sums a source, and a map from kinds of errors to how many there were.

    With idle_ms, a timer that each batch of a source sets anew says so when nothing has come for as long.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "tokens long, documents long, examples long, errors long, failing long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def _row(self, key: tuple, sums: tuple, idle: bool) -> pd.DataFrame:
        kinds = {k[0]: v[0] for k, v in self.kinds.iterator()}
        return pd.DataFrame([(key[0], *sums, kinds, idle)], columns=["source", "tokens", "documents", "examples", "errors", "failing", "kinds", "idle"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, documents, examples, errors, failing = self.sums.get() if self.sums.exists() else _ZERO
        kinds: dict[str, int] = {}
        frames = sorted((x for x in rows if len(x)), key=lambda x: x["order"].min())
        for x in frames:
            x = x.sort_values("order", kind="stable")
            bad = x["error"].notna().to_numpy()
            examples, errors = examples + len(x), errors + int(bad.sum())
            documents, tokens = documents + int(x["kept"].sum()), tokens + int(x.loc[x["kept"], "tokens"].sum())
            good = (~bad).nonzero()[0]
            failing = len(x) - 1 - int(good[-1]) if len(good) else failing + len(x)
            for k, n in x.loc[bad, "error"].value_counts().items():
                kinds[k] = kinds.get(k, 0) + int(n)
        for k, n in kinds.items():
            self.kinds.updateValue((k,), ((self.kinds.getValue((k,))[0] if self.kinds.containsKey((k,)) else 0) + n,))
        sums = tokens, documents, examples, errors, failing
        self.sums.update(sums)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, sums, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, self.sums.get(), True)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Lets streams that start from now on keep values, maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def source_books(rows: DataFrame, *, source: str, order: str, tokens: str, kept: str, error: str, idle_ms: int | None = None) -> DataFrame:
    """BOOKS of a stream, in update mode: a row for each source that a batch has rows of, with what it has given so far.

    kept: whether a row became a document; error: what went wrong with it, or null.  `failing`: how many
    rows failed in a row up to now.  Null numbers count as 0, a null `kept` as false.  Rows of a batch are
    taken by `order`, frame by frame.
    """
    keyed_state(rows.sparkSession)
    own = rows.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("order"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"),
        F.coalesce(F.col(kept), F.lit(False)).alias("kept"), F.col(error).cast("string").alias("error"),
    )
    return own.groupBy("source").transformWithStateInPandas(SourceBooks(idle_ms), BOOKS, "Update", "ProcessingTime" if idle_ms is not None else "None")
