"""A quality classifier: a byte-level convolutional network in numpy.

Every byte of a text becomes a few channels (kind of character, a fixed random code of the byte, and
whether its word begins a run of bytes that the same text had before).  Learned filters run over the
whole text in overlapping chunks; each chunk keeps every filter's largest response, a text keeps the
mean and the largest over its chunks, and a logistic unit over these and the text's length gives one
probability.  Only where a filter was largest does its gradient flow, so learning costs little more
than scoring.

Fitted on the driver on a bounded sample of learnable labelled rows (`sample_docs` of each label,
chosen by hash, twice as many at most where ids repeat, texts of at most `sample_bytes`); scoring takes every byte of every text, in parts of
bounded size.  Labels other than 0 and 1 and null texts are not learned from; repeated label rows
count as often as they are there.  Without both labels in the sample every score is the label's share
(0.5 without any).  Null text: scored as the empty text.  Very long texts take longer only; equal
texts have equal scores, whatever their row, and a score of 0.5 predicts 1.  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import learnable, text_of


@dataclass(frozen=True)
class Settings:
    filters: int = 24
    width: int = 8
    step: int = 2
    chunk: int = 256
    codes: int = 4
    repeat_bytes: int = 16
    epochs: int = 14
    enough: float = 0.003  # mean loss of an epoch after which no other follows
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    sample_docs: int = 1500
    sample_bytes: int = 20_000
    seed: int = 5


#: Bytes taken through the filters at once.
PART = 1 << 18


def channels(settings: Settings) -> np.ndarray:
    """The fixed channels of each byte; the last row is padding."""
    b = np.arange(257)
    kinds = [
        (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), (b == 32) | (b == 9), b == 10,
        np.isin(b, list(b".,;:!?'\"()-")), np.isin(b, list(b"#$%&*+/<=>@[\\]^_`{|}~")), (b >= 128) & (b < 256),
    ]
    random = np.random.default_rng(settings.seed).normal(0, 0.5, (257, settings.codes))
    random[256] = 0
    return np.concatenate([np.stack(kinds, 1).astype(np.float32), random.astype(np.float32)], axis=1)


def repeats(data: np.ndarray, n: int) -> np.ndarray:
    """1 for the bytes of words at which n bytes begin that the text had at an earlier word."""
    out = np.zeros(len(data), np.float32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    starts = starts[starts + n <= len(data)]
    if len(starts) < 2:
        return out
    keys = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            keys = keys * np.uint64(0x100000001B3) + data[starts + k] + np.uint64(1)
    _, first, where = np.unique(keys, return_index=True, return_inverse=True)
    again = first[where] < np.arange(len(starts))
    ends = np.concatenate([starts[1:], [min(len(data), starts[-1] + n)]])
    mark = np.zeros(len(data) + 1, np.float32)
    np.add.at(mark, starts[again], 1)
    np.add.at(mark, ends[again], -1)
    return np.cumsum(mark[:-1], dtype=np.float32)


@dataclass
class Net:
    settings: Settings
    filters: np.ndarray  # (width * channels) x filters
    bias: np.ndarray
    head: np.ndarray  # mean of chunks, largest of chunks, length
    offset: float
    constant: float | None = None
    table: np.ndarray = field(default=None)
    ready: tuple | None = None  # the taps of a net that learns no more

    def taps(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each place of a filter, its response to every byte, and its weight of a repeated byte: an input is one of 257 rows, so a product is a look-up."""
        by_place = self.filters.reshape(self.settings.width, self.table.shape[1] + 1, -1)
        return [self.table @ w[:-1] for w in by_place], by_place[:, -1]

    def inputs(self, data: np.ndarray, again: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (256: none) and repeat marks of chunks [begin, end)."""
        s = self.settings
        a, b = begin * s.chunk, end * s.chunk + s.width
        values, marks = np.full(b - a, 256, np.intp), np.zeros(b - a, np.float32)
        own = data[a:b]
        values[: len(own)], marks[: len(own)] = own, again[a:b]
        return values, marks

    def chunks(self, data: np.ndarray, again: np.ndarray, keep: bool = False, taps: tuple | None = None):
        """Each chunk's largest responses; with keep, also the inputs where they stood."""
        s = self.settings
        tables, repeated = taps or self.taps()
        total, per = max(1, -(-len(data) // s.chunk)), PART // s.chunk
        out, at = [], []
        for begin in range(0, total, per):
            end = min(total, begin + per)
            values, marks = self.inputs(data, again, begin, end)
            n = (end - begin) * s.chunk
            r = np.take(tables[0], values[:n : s.step], axis=0)
            for k in range(1, s.width):
                r += np.take(tables[k], values[k : k + n : s.step], axis=0)
            for k in range(s.width) if marks.any() else ():
                some = np.flatnonzero(marks[k : k + n : s.step])
                r[some] += marks[k : k + n : s.step][some, None] * repeated[k]
            r = r.reshape(end - begin, s.chunk // s.step, -1)
            if keep:
                where = r.argmax(axis=1)
                out.append(np.take_along_axis(r, where[:, None, :], axis=1)[:, 0, :])
                places = (np.arange(end - begin)[:, None] * s.chunk + where * s.step)[:, :, None] + np.arange(s.width)
                x = np.concatenate([self.table[values[places]], marks[places][..., None]], axis=-1)
                at.append(x.reshape(*where.shape, -1))
            else:
                out.append(r.max(axis=1))
        best = np.maximum(np.concatenate(out) + self.bias, 0)
        return (best, np.concatenate(at)) if keep else best

    def summary(self, best: np.ndarray, n_bytes: int) -> np.ndarray:
        return np.concatenate([best.mean(axis=0), best.max(axis=0), [np.log1p(n_bytes) / 5]])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        z = self.summary(self.chunks(data, repeats(data, self.settings.repeat_bytes), taps=self.ready), len(data)) @ self.head + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Net:
    rng = np.random.default_rng(settings.seed)
    table = channels(settings)
    c, f = table.shape[1] + 1, settings.filters
    net = Net(settings, rng.normal(0, (2 / (settings.width * c)) ** 0.5, (settings.width * c, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.1, 2 * f + 1), 0.0, None, table)
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    docs = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    docs = [(d, repeats(d, settings.repeat_bytes)) for d in docs]
    # classes weigh as they do in the sample's source: threshold 0.5 then splits a balanced sample
    params = [net.filters, net.bias, net.head, np.zeros(1)]
    m, v, t = [np.zeros_like(p, dtype=float) for p in params], [np.zeros_like(p, dtype=float) for p in params], 0
    steps = settings.epochs * -(-len(docs) // settings.batch)
    for _ in range(settings.epochs):
        order, loss = rng.permutation(len(docs)), 0.0
        for begin in range(0, len(order), settings.batch):
            grads = [np.zeros(p.shape) for p in params]
            some = order[begin : begin + settings.batch]
            taps = net.taps()
            for i in some:
                data, again = docs[i]
                best, at = net.chunks(data, again, keep=True, taps=taps)
                s = net.summary(best, len(data))
                p = 1 / (1 + np.exp(-np.clip(s @ net.head + params[3][0], -30, 30)))
                e = (p - y[i]) / len(some)
                loss -= np.log(max(1e-12, p if y[i] else 1 - p))
                grads[2] += e * s
                grads[3] += e
                d = np.repeat(net.head[None, :f] * (e / len(best)), len(best), axis=0)
                d[best.argmax(axis=0), np.arange(f)] += e * net.head[f : 2 * f]
                d *= best > 0
                grads[1] += d.sum(axis=0)
                grads[0] += np.einsum("nf,nfk->kf", d, at, optimize=True)
            t += 1
            rate = settings.rate * (1 - t / (steps + 1))
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g + settings.decay * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
        if loss / len(docs) < settings.enough:
            break
    net.offset = float(params[3][0])
    net.ready = net.taps()
    return net


def learn(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", settings: Settings = Settings()) -> Net:
    """Samples learnable labelled rows: the hash's threshold for each label comes from the labels alone; the rows that it takes are bounded once more."""
    known = labels.filter(F.col(label_column).isin(0, 1) & learnable(id_column)).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label"), F.pmod(F.xxhash64(F.col(id_column), F.lit(settings.seed)), F.lit(1 << 30)).alias("_u"))
    counts = known.groupBy("_label").count()
    chosen = known.join(counts, "_label").filter(F.col("_u") < F.lit(float(1 << 30)) * settings.sample_docs / F.col("count")).select("_id", "_label", "_u")
    rows = df.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    # ids of the sample only, whose number is bounded; an id may have any number of rows
    some = rows.join(F.broadcast(chosen), "_id").filter(F.octet_length("_text") <= settings.sample_bytes).withColumn("_h", F.xxhash64("_u", "_text"))
    taken = [r for label in (0, 1) for r in some.filter(F.col("_label") == label).orderBy("_h", "_id", "_text").limit(2 * settings.sample_docs).collect()]
    taken.sort(key=lambda r: (r["_u"], r["_id"], r["_text"], r["_label"]))
    return fit([r["_text"] for r in taken], [r["_label"] for r in taken], settings)


def quality_scores(df: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", settings: Settings = Settings()) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_column=id_column, text_column=text_column, label_column=label_column, settings=settings))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score, na_action=None).astype(float)

    out = df.select(F.col(id_column).alias("doc_id"), (~learnable(id_column)).alias("held_out"), F.pandas_udf(run, "double")(text_of(text_column)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
