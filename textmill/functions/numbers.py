"""Numeric rules of training and evaluation, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import col, strip


def ramp(seen: Column, start: float, most: float, ramp_tokens: int, enabled: bool = True) -> Column:
    """A probability that rises along a quarter sine from start to most over ramp_tokens."""
    if not enabled:
        return F.lit(0.0)
    return F.lit(start) + F.lit(most - start) * F.sin(F.lit(math.pi / 2) * F.least(seen / F.lit(float(max(ramp_tokens, 1))), F.lit(1.0)))


def learning_rate(step: Column, peak: float, floor: float, warm_up: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    done = F.least((step - warm_up) / F.lit(float(max(1, total - warm_up))), F.lit(1.0))
    return F.when(step < warm_up, F.lit(peak) * (step + 1) / F.lit(float(max(1, warm_up)))).otherwise(F.lit(floor) + F.lit(peak - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def learning_rate_by_ratio(step: Column, peak: float, warm_up_ratio: float, total: int, floor_ratio: float = 0.1, start_ratio: float = 0.05) -> Column:
    """The other schedule: a warm-up over a share of all steps from start_ratio of the peak, then a cosine down to floor_ratio of it."""
    warm_up = math.floor(warm_up_ratio * total)
    low = floor_ratio * peak
    rising = F.lit(peak) * (F.lit(start_ratio) + F.lit(1 - start_ratio) * step / F.lit(float(max(1, warm_up))))
    done = F.least((step - warm_up) / F.lit(float(max(1, total - warm_up))), F.lit(1.0))
    return F.when(step < warm_up, rising).otherwise(F.lit(low) + F.lit(peak - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def total_steps(tokens: Column, per_step: Column) -> Column:
    """Optimizer steps that so many tokens (or rows) make, the last one not full."""
    return F.ceil(tokens / per_step).cast("long")


def next_multiple(now: Column, interval: int) -> Column:
    return ((F.floor(now / interval) + 1) * interval).cast("long")


def back_off(failures: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))))


def token_width(vocabulary: Column) -> Column:
    return F.when(vocabulary < 65535, 2).otherwise(4)


def shard_tokens(gib: Column, safety: float, bytes_per_token: float, width: Column, remaining: Column) -> Column:
    """How many tokens a shard may have, by disk budget, cut to what remains."""
    return F.least((gib * F.lit(float(1 << 30)) * safety / (F.lit(bytes_per_token) + width + 0.05)).cast("long"), remaining)


def tokens_per_step(batch: Column, length: Column, accumulate: Column, world: Column) -> Column:
    return batch * length * accumulate * world


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def metric(x: Column | str) -> Column:
    """A metric's text as a number; a percentage is divided by 100; what isn't a finite number is null."""
    text = strip(x)
    percent = text.endswith("%")
    number = finite(strip(F.regexp_replace(text, "%$", "")).try_cast("double"))
    return F.when(percent, number / 100).otherwise(number)


def metric_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def is_metric(key: Column | str, name: str) -> Column:
    plain = "".join(c for c in name.lower() if c.isascii() and c.isalnum())
    return metric_key(key).isin(*({plain} | ({"passat1", "passk1"} if plain == "pass1" else set())))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - C(n-c, k) / C(n, k), as a product."""
    factors = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - F.aggregate(factors, F.lit(1.0), lambda a, x: a * x))


def throughput(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(1e-6))


def reward(passed: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), passed / total)))


def divides(batch: Column, accumulate: Column, world: Column, generations: Column) -> Column:
    """Whether a global batch splits into whole groups of generations."""
    return (batch * accumulate * world) % generations == 0


def rows_within(rows: Column, target: Column) -> Column:
    """How many rows of a loaded table count: all there are, up to the target; the target where nothing is known."""
    return F.coalesce(F.least(rows, target), target)
