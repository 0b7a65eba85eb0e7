"""Choices: from logits, between weighted sources, and between matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions.text import uniform


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def falling(vector: Column) -> Column:
    """A vector's elements as structs (id, z), the largest first, smaller index first among equals."""
    marked = F.transform(vector, lambda z, i: F.struct((-z.cast("double")).alias("n"), i.alias("id")))
    return F.transform(F.array_sort(marked), lambda x: F.struct(x["id"].alias("id"), (-x["n"]).alias("z")))


def top_k(vector: Column, k: int) -> Column:
    """The k largest of a vector, as in `falling`."""
    return F.slice(falling(vector), 1, k)


def top_k_with_ties(rows: DataFrame, k: int, *, key: str) -> DataFrame:
    """All that are not below the k-th largest."""
    return rows.withColumn("place", F.rank().over(W.partitionBy(key).orderBy(F.desc("z")))).filter(F.col("place") <= k)


def softmax(vector: Column, temperature: float = 1.0) -> Column:
    """A vector's probabilities."""
    scaled = _let(F.array_max(vector).cast("double"), lambda most: F.transform(vector, lambda z: F.exp((z.cast("double") - most) / temperature)))
    return _let(scaled, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)))


def nucleus(p: Column, most: float) -> Column:
    """The largest probabilities, as in `falling`, until those before hold more than `most`; the first always stays."""
    def kept(ranked: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"))
        held = F.aggregate(ranked, start, lambda s, x: F.struct((s["before"] + x["z"]).alias("before"), (s["n"] + (s["before"] <= most).cast("int")).alias("n")), lambda s: s["n"])
        return F.slice(ranked, 1, held)

    return _let(falling(p), kept)


def argmax(vector: Column) -> Column:
    """The index of the largest element, the smallest among equals."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def multinomial(p: Column, draw: Column) -> Column:
    """The first index at which the running sum of probabilities passes a number drawn from [0, 1); null if none does."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("n"))
    below = F.aggregate(p, start, lambda s, x: F.struct((s["upto"] + x).alias("upto"), (s["n"] + (s["upto"] + x <= draw).cast("int")).alias("n")), lambda s: s["n"])
    return _let(below, lambda n: F.when(n < F.size(p), n))


def intervals(weights: DataFrame, *, key: str, weight: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds low and high: consecutive shares of [0, 1) by weight, negative weights as 0.  One row a choice, so a configuration's size."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    upto, all_ = W.partitionBy(*within).orderBy(key), W.partitionBy(*within)
    high = F.sum(w).over(upto)
    return weights.withColumns({"low": (high - w) / F.sum(w).over(all_), "high": high / F.sum(w).over(all_)}).filter(w > 0)


def choose(rows: DataFrame, groups: DataFrame, sources: DataFrame, *, key: str, seed: int) -> DataFrame:
    """A group by weight, then a source of the group by weight, for each row.

    groups: group, weight; sources: group, source_id, weight.  Groups without sources are left out.
    """
    live = groups.join(sources.select("group").distinct(), "group", "left_semi")
    g = F.broadcast(intervals(live, key="group", weight="weight").select("group", F.col("low").alias("gl"), F.col("high").alias("gh")))
    s = F.broadcast(intervals(sources, key="source_id", weight="weight", within=["group"]).select(F.col("group").alias("of"), "source_id", "low", "high"))
    drawn = rows.withColumns({"_g": uniform(str(seed), F.col(key), "group"), "_s": uniform(str(seed), F.col(key), "source")})
    with_group = drawn.join(g, (F.col("_g") >= F.col("gl")) & (F.col("_g") < F.col("gh")))
    return with_group.join(s, (F.col("group") == F.col("of")) & (F.col("_s") >= F.col("low")) & (F.col("_s") < F.col("high"))).drop("_g", "_s", "gl", "gh", "of", "low", "high")


def one_of(matches: Column, *draw: Column | str) -> Column:
    return F.get(matches, F.least(F.floor(uniform(*draw) * F.size(matches)), F.size(matches) - 1).cast("int"))


def until(ids: Column, end: int) -> Column:
    """Ids before the first end id; all without one."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, 1, (at - 1).cast("int"))).otherwise(ids)


def expert_balance(rows: DataFrame, experts: int, *, expert: str) -> DataFrame:
    """expert, n, update: how often each was chosen, none left out, and the sign of the mean less that."""
    spark = rows.sparkSession
    counts = spark.range(experts).select(F.col("id").cast("int").alias("expert")).join(rows.groupBy(F.col(expert).cast("int").alias("expert")).agg(F.count("*").alias("n")), "expert", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.join(F.broadcast(mean)).select("expert", "n", F.signum(F.col("mean") - F.col("n")).cast("int").alias("update"))


def router_loss(rows: DataFrame, p: Column, experts: int) -> DataFrame:
    """One row: experts times the sum over experts of (share of first choices) * (mean probability).  p: each row's probabilities."""
    marked = rows.select(p.alias("p")).select("p", argmax(F.col("p")).alias("first"))
    by = marked.select("first", F.posexplode("p").alias("id", "p")).groupBy("id").agg(F.avg((F.col("id") == F.col("first")).cast("int")).alias("share"), F.avg("p").alias("mean"))
    return by.agg((F.sum(F.col("share") * F.col("mean")) * experts).alias("loss"))


def mean_vector(df: DataFrame, vector: str, chosen: Column) -> DataFrame:
    """One row: the mean of the chosen vectors, or of all if none is chosen."""
    parts = df.select(chosen.alias("c"), F.posexplode(vector).alias("dim", "z")).withColumn("z", F.col("z").cast("double"))
    means = parts.groupBy("dim").agg(F.coalesce(F.avg(F.when(F.col("c"), F.col("z"))), F.avg("z")).alias("mean"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("mean"))


def difference(a: Column, b: Column) -> tuple[Column, Column]:
    """Largest and mean absolute difference of two vectors."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.array_max(d), F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
