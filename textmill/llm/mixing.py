"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same set of sources (a membership pattern) are alike to the flow, so
one aggregate gives its nodes: the words of each pattern.  From each pattern its words can be taken
once for nothing, a second time at a cost, a third time at a higher one (convex costs, so the flow
uses repeats only where single use can't meet the targets); each source takes up to its target.  The
flow over patterns and sources is solved on the driver, whose share of the data is one row for each pattern.

The words that flow from a pattern lie on a line: first pass over its documents in seeded order,
second pass, and so on; sources have successive stretches of that line.  A document belongs to a
stretch if its middle does, so a source misses its amount by half a document at each end at most.
The document order's keys at the ends of stretches come from histograms of the key's leading bits,
refined bit group by bit group, and a sort of the few documents of one last bin: no pattern is ever
sorted as a whole, and none meets in one task.

Null or empty texts: size 0, never taken.  Null source: a source of its own, ordered last.  Rows
with equal id and text stand at one place of the order and are taken alike, and so are ties of its
60-bit key.  A very long text is as many words; it misses a source's amount by half of them at most.
Empty table: no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.llm.common import saved, text_of, words_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows up to which a table of patterns is broadcast; a larger one is joined as any other.
BROADCAST_ROWS = 100_000
#: Bits of the order key that one histogram resolves, and rows in a last bin that are sorted.
STEP_BITS, KEY_BITS, SORT_ROWS = 12, 60, 20_000


def allot(sizes: dict, weights: dict, share: float = 1.0, most: float = 3.0) -> dict:
    """Targets: share of all sizes by weight, none above most times its size; what that leaves goes to the others by weight."""
    left, open_, out = share * sum(sizes.values()), {s for s in sizes if sizes[s] > 0 and weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    while open_ and left > 0:
        total = sum(weights[s] for s in sorted(open_, key=_order))
        full = {s for s in open_ if left * weights[s] / total >= most * sizes[s]}
        if not full:
            for s in open_:
                out[s] = left * weights[s] / total
            break
        for s in sorted(full, key=_order):
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def _order(source: str | None) -> tuple:
    return (source is None, source or "")


def min_cost_flow(patterns: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple[tuple, str | None], int]:
    """Words from each pattern to each of its sources; all cheapest paths at once, cost by cost, so the flow is as large as it can be at least cost."""
    names = {x: i + 2 for i, x in enumerate([*(("p", p) for p in patterns), *(("s", s) for s in targets)])}
    graph: list[list[int]] = [[] for _ in range(len(names) + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    links = {}
    for p, size in patterns.items():
        for k in range(repeats):
            arc(0, names["p", p], size, k * k)
        for s in p:
            links[p, s] = arc(names["p", p], names["s", s], size * repeats, 0)
    for s, target in targets.items():
        arc(names["s", s], 1, round(target), 0)
    while True:
        far, waiting, queued = [float("inf")] * len(graph), deque([0]), [False] * len(graph)
        far[0] = 0
        while waiting:
            x = waiting.popleft()
            queued[x] = False
            for a in graph[x]:
                if room[a] > 0 and far[x] + cost[a] < far[to[a]]:
                    far[to[a]] = far[x] + cost[a]
                    if not queued[to[a]]:
                        waiting.append(to[a])
                        queued[to[a]] = True
        if far[1] == float("inf"):
            return {x: room[a ^ 1] for x, a in links.items() if room[a ^ 1]}
        _fill(graph, to, room, lambda x, a, far=far: far[to[a]] == far[x] + cost[a])


def _fill(graph: list[list[int]], to: list[int], room: list[int], cheapest) -> None:
    """Largest flow from 0 to 1 along the cheapest arcs alone, level by level."""
    while True:
        level, waiting = [-1] * len(graph), deque([0])
        level[0] = 0
        while waiting:
            x = waiting.popleft()
            for a in graph[x]:
                if room[a] > 0 and level[to[a]] < 0 and cheapest(x, a):
                    level[to[a]] = level[x] + 1
                    waiting.append(to[a])
        if level[1] < 0:
            return
        tried, path, x = [0] * len(graph), [], 0
        while True:
            if x == 1:
                amount = min(room[a] for a in path)
                for a in path:
                    room[a] -= amount
                    room[a ^ 1] += amount
                full = next(k for k, a in enumerate(path) if not room[a])
                x = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[x] < len(graph[x]):
                a = graph[x][tried[x]]
                if room[a] > 0 and level[to[a]] == level[x] + 1 and cheapest(x, a):
                    break
                tried[x] += 1
            if tried[x] < len(graph[x]):
                path.append(a)
                x = to[a]
            elif path:
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                break


def _marks(line: DataFrame, wanted: list[tuple[int, float]]) -> dict[tuple[int, float], int]:
    """For (pattern, words): the key from which on documents' middles lie beyond so many words of the pattern's order.

    line: _p, _key, _size.  The state on the driver is one row for each wanted pair.
    """
    spark = line.sparkSession
    state = [(p, t, 0, t) for p, t in wanted]  # pattern, words, leading bits of the bin so far, words within it
    taken, out = 0, {}
    schema = "_p int, _t double, _bin long, _rest double"
    while state:
        shift, step = KEY_BITS - taken - STEP_BITS, STEP_BITS
        at = spark.createDataFrame(state, schema)
        own = line.withColumn("_bin", F.shiftright("_key", KEY_BITS - taken) if taken else F.lit(0).cast("long"))
        bins = own.join(F.broadcast(at.select("_p", "_bin").distinct()), ["_p", "_bin"], "left_semi").groupBy("_p", "_bin", F.shiftright("_key", shift).alias("_next")).agg(F.sum("_size").alias("n"), F.count("*").alias("rows"), F.max("_size").alias("most"))
        joined = at.join(bins, ["_p", "_bin"])
        before = F.sum("n").over(W.partitionBy("_p", "_t").orderBy("_next").rowsBetween(W.unboundedPreceding, -1))
        # the bin where the running sum passes the mark; half a document may decide, so the bin after the last full one
        found = joined.withColumn("b", F.coalesce(before, F.lit(0))).filter((F.col("b") <= F.col("_rest")) & (F.col("_rest") < F.col("b") + F.col("n"))).select("_p", "_t", "_next", (F.col("_rest") - F.col("b")).alias("_rest"), "rows").collect()
        hit = {(r["_p"], r["_t"]) for r in found}
        out |= {(p, t): 1 << KEY_BITS for p, t, _, _ in state if (p, t) not in hit}
        taken += step
        state = [(r["_p"], r["_t"], r["_next"], r["_rest"]) for r in found if r["rows"] > SORT_ROWS and taken < KEY_BITS]
        last = [(r["_p"], r["_t"], r["_next"], r["_rest"]) for r in found if not (r["rows"] > SORT_ROWS and taken < KEY_BITS)]
        if last:
            few = spark.createDataFrame(last, schema)
            rows = line.withColumn("_bin", F.shiftright("_key", KEY_BITS - taken)).join(F.broadcast(few), ["_p", "_bin"])
            rows = rows.groupBy("_p", "_t", "_rest", "_bin", "_key").agg(F.sum("_size").alias("n"))
            sums = F.coalesce(F.sum("n").over(W.partitionBy("_p", "_t").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            rows = rows.withColumn("beyond", sums + F.col("n") / 2 >= F.col("_rest"))
            ends = rows.groupBy("_p", "_t", "_bin").agg(F.min(F.when(F.col("beyond"), F.col("_key"))).alias("key")).collect()
            for r in ends:
                out[r["_p"], r["_t"]] = r["key"] if r["key"] is not None else (r["_bin"] + 1) << (KEY_BITS - taken)
    return out


def _placed(df: DataFrame, id_column: str, text_column: str, source: str | Column, seed: int) -> DataFrame:
    """df with _id, _text_key, _size, _names (its sources, null as null) and _key (its place in the seeded order)."""
    column = F.col(source) if isinstance(source, str) else source
    several = dict(df.select(column.alias("s")).dtypes)["s"].startswith("array")
    names = F.when(column.isNull() | (F.size(column) == 0), F.array(F.lit(None).cast("string"))).otherwise(column.cast("array<string>")) if several else F.array(column.cast("string"))
    text = text_of(text_column)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column), F.xxhash64(text)), 64 - KEY_BITS)
    return df.withColumns({"_id": F.col(id_column), "_text_key": F.xxhash64(text), "_size": F.size(words_of(text)).cast("long"), "_names": F.sort_array(F.array_distinct(names), asc=False), "_key": key})


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def times(
    df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source: str | Column = "source",
    weights: Sequence[float] | dict = WEIGHTS, share: float = 1.0, repeats: int = 3, seed: int = 7,
) -> DataFrame:
    """df with one row for each row and source it belongs to, and columns _id, _text_key, _size, _source, _source_size, _target, _times.

    Two passes over df: one for the plan, and the projection that is returned; df's columns never move.
    """
    spark = df.sparkSession
    base = saved(_placed(df, id_column, text_column, source, seed).select("_size", "_names", "_key"), "mix-documents")
    found = base.groupBy("_names").agg(F.sum("_size").alias("n")).collect()
    patterns = {tuple(sorted(r["_names"], key=_order)): int(r["n"]) for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=_order)
    by_source = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    targets = allot({s: sizes[s] for s in ordered}, by_source, share * sum(patterns.values()) / max(1, sum(sizes.values())), repeats)
    flow = min_cost_flow(patterns, targets, repeats)

    numbers = {p: i for i, p in enumerate(sorted(patterns, key=lambda p: [_order(s) for s in p]))}
    stretches, wanted = [], set()
    for p, i in numbers.items():
        at, size = 0, patterns[p]
        for s in p:
            end = at + flow.get((p, s), 0)
            stretches.append((i, s, at, end, size))
            wanted |= {(i, float(x % size)) for x in (at, end) if size and x % size}
            at = end
    ids = spark.createDataFrame([(list(p), i) for p, i in numbers.items()] or [([], -1)], "_sorted array<string>, _p int")
    # sets of names in the order that sort_array gives
    ids = _small(ids.select(F.sort_array("_sorted", asc=False).alias("_names"), "_p"), len(numbers))
    marks = _marks(base.join(ids, "_names").select("_p", "_key", "_size"), sorted(wanted))
    plan = []
    for i, s, at, end, size in stretches:
        # the stretch, pass by pass: whole passes, and runs of keys
        whole, runs = 0, []
        if size and end > at:
            cuts = [at, *range((at // size + 1) * size, end, size), end]
            for a, b in pairwise(cuts):
                low = marks[i, float(a % size)] if a % size else 0
                high = marks[i, float(b % size)] if b % size else 1 << KEY_BITS
                if (low, high) == (0, 1 << KEY_BITS):
                    whole += 1
                elif low < high:
                    runs.append((low, high))
        plan.append((i, s, sizes[s], float(targets[s]), whole, runs))
    rows = spark.createDataFrame(plan or [(-1, None, 0, 0.0, 0, [])], "_p int, _source string, _source_size long, _target double, _whole int, _runs array<struct<low:long,high:long>>")
    out = _placed(df, id_column, text_column, source, seed)
    out = out.join(ids, "_names").join(_small(rows, len(plan)), "_p")
    count = F.when(F.col("_size") > 0, F.col("_whole") + F.size(F.filter("_runs", lambda r: (F.col("_key") >= r["low"]) & (F.col("_key") < r["high"])))).otherwise(0)
    return out.withColumn("_times", count.cast("int")).drop("_p", "_names", "_key", "_whole", "_runs")


def mix(df: DataFrame, **options) -> DataFrame:
    """One row for each document and source it belongs to; options as for `times`.

    source: a column of a name, or of an array of names (a document in several sources).  weights: by
    source, or a cycle for the sources in code point order, null last.  Columns: doc_id, text_key
    (hash of the text), source, size, source_size, target, taken (words, repeats counted), times.
    """
    out = times(df, **options)
    return out.select(F.col("_id").alias("doc_id"), F.col("_text_key").alias("text_key"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_times") * F.col("_size")).cast("long").alias("taken"), F.col("_times").alias("times"))


def mixed(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))  # whatever columns are called, none is lost
    own = {"id_column": f"_row.`{id_column}`", "text_column": f"_row.`{text_column}`", "source": f"_row.`{source}`"}
    out = times(rows, **own, **options).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))
    return out.select("_row.*")
