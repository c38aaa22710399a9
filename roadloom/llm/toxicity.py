"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct runs of 4, 5 and 6 characters of its lower-case form (ASCII other than letters read as
spaces), hashed into 2**20 buckets. For each bucket the log ratio of its rates in toxic and in other texts is its scale; buckets
whose rates don't differ beyond chance are left out, so a long clean text adds up no noise, and of the others the FEATURES
(a parameter) that differ most beyond it are kept. A logistic regression is then fitted on the scaled features. It learns from at most SAMPLE labelled rows (by a hash of the id, never from
held-out rows); ratios and weights come from those rows. Scores are logistic, from 0 to 1.

Null texts count as empty; an empty text gets the score of the intercept alone. Rows of labels without id or label are
left out; of repeated labels for an id, one toxic label is enough. Repeated rows are scored each. With no labelled row
of either class every score is that class's share (0 with none). Other columns of docs are dropped or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .shared import held_out, map_arrow, with_text, written

SAMPLE = 16_000
GRAMS = (4, 5, 6)
BITS = 20
FEATURES = 1 << 14
MIN_COUNT = 4
CHANCE = 4.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass
class Model:
    """Weights of the buckets that are kept, and the intercept; small, as it goes to every task."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bucket] = self.weight
        return out


def _letters(data: np.ndarray) -> np.ndarray:
    data = textnp.lower(data)
    keep = (data >= 128) | ((data >= 97) & (data <= 122))
    return np.where(keep, data, np.uint8(32))


def characters(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 texts, and where each text's characters begin."""
    first = (data & 0xC0) != 0x80
    if first.all():
        return data.astype(np.uint64), begins
    at = np.flatnonzero(first)
    code, size = data[at].astype(np.uint64), np.diff(np.append(at, len(data)))
    for j in range(1, 4):
        longer = np.flatnonzero(size > j)
        code[longer] |= data[at[longer] + j].astype(np.uint64) << np.uint64(8 * j)
    return code, np.append(0, np.cumsum(first))[begins]


def gram_buckets(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the text and the bucket of every run of n characters; a text stands between two spaces."""
    code, begins = characters(_letters(data), begins)
    n_texts = len(begins) - 1
    padded = np.full(len(code) + 2 * n_texts, 32, np.uint64)
    text = np.repeat(np.arange(n_texts), np.diff(begins))
    padded[np.arange(len(code)) + 2 * text + 1] = code
    ends = begins[1:] + 2 * np.arange(1, n_texts + 1)
    owner = np.repeat(np.arange(n_texts), np.diff(begins) + 2)
    run = padded
    for n in range(2, max(GRAMS) + 1):
        if len(padded) < n:
            return
        run = run[: len(padded) - n + 1] * _STEP + padded[n - 1 :]
        if n in GRAMS:
            own = np.arange(len(run)) + n <= ends[owner[: len(run)]]
            mixed = run[own] * _ODD
            bucket = ((mixed ^ (mixed >> np.uint64(29))) * _ODD + np.uint64(n) * _STEP) >> np.uint64(64 - BITS)
            yield owner[: len(run)][own], bucket.astype(np.int64)


def _present(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of texts: its range, then text and bucket of each distinct n-gram with wanted[bucket]."""
    data, begins = textnp.text_bytes(column)
    for low, high in textnp.chunks(begins):
        own = begins[low : high + 1] - begins[low]
        found = [np.zeros(0, np.int64)]
        for owner, bucket in gram_buckets(data[begins[low] : begins[high]], own):
            if wanted is not None:
                hit = wanted[bucket]
                owner, bucket = owner[hit], bucket[hit]
            found.append(np.unique(owner.astype(np.int64) << BITS | bucket))
        both = np.unique(np.concatenate(found))
        yield low, high, both >> BITS, both & ((1 << BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text, y of at most `sample` labelled rows outside the held-out fifth; a small table, written."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return written(with_text(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")


def fit(sample: DataFrame, most: int = FEATURES) -> Model:
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, toxic = sum(totals.values()), totals.get(1, 0)
    none = np.zeros(0, np.int64)
    if toxic in (0, n):
        return Model(none, none, 40.0 if n and toxic == n else -40.0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for low, high, owner, bucket in _present(batch.column(0), None):
                for c in (0, 1):
                    found[c] += np.bincount(bucket[y[low:high][owner] == c], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(found.sum(axis=0))
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[0, part].astype(np.int64)), pa.array(found[1, part].astype(np.int64))], names=["bucket", "clean", "toxic"])

    per = map_arrow(sample.select("text", "y"), counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / F.lit(float(toxic)), F.col("clean") / F.lit(float(n - toxic))
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n))
    beyond = F.abs(p - q) / F.sqrt(share * (F.lit(1.0) - share) * F.lit(1.0 / toxic + 1.0 / (n - toxic)) + F.lit(1e-12))
    top = per.filter(F.col("clean") + F.col("toxic") >= MIN_COUNT).withColumn("z", beyond).filter(F.col("z") >= CHANCE).orderBy(F.desc("z"), "bucket").limit(most).toPandas()
    if top.empty:
        return Model(none, none, float(np.log(toxic / (n - toxic))))
    ratio = np.log(((top.toxic + 1) / (toxic + 2)) / ((top.clean + 1) / (n - toxic + 2))).to_numpy(np.float64)
    kept = top.bucket.to_numpy()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(1 << BITS, -1, np.int32)
        index[kept] = np.arange(len(kept))
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for low, high, owner, bucket in _present(batch.column(0), index >= 0):
                cuts = np.searchsorted(owner, np.arange(1, high - low))
                yield pa.RecordBatch.from_arrays([pa.array(y[low:high]), pa.array([x.tobytes() for x in np.split(index[bucket], cuts)], pa.binary())], names=["y", "on"])

    rows = map_arrow(sample.select("text", "y"), features, "y long, on binary").toPandas()
    y = rows.y.to_numpy(np.float64)
    sizes = np.array([len(x) // 4 for x in rows.on])
    on = np.frombuffer(b"".join(rows.on), np.int32)
    weight, bias = logistic(on, np.repeat(np.arange(len(y), dtype=np.int32), sizes), y, ratio)
    return Model(kept, (weight * ratio).astype(np.float32), bias)


def logistic(on: np.ndarray, row: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of scaled binary features, by Adam over all rows; features are taken in slices, so no copy of them is made."""
    w, b = np.zeros(len(scale)), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    cuts = range(0, len(on), 1 << 19)
    for t in range(1, steps + 1):
        z, scaled, pull = np.full(len(y), b), w * scale, np.zeros(len(scale))
        for k in cuts:
            z += np.bincount(row[k : k + (1 << 19)], scaled[on[k : k + (1 << 19)]], minlength=len(y))
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        for k in cuts:
            pull += np.bincount(on[k : k + (1 << 19)], miss[row[k : k + (1 << 19)]], minlength=len(scale))
        g = np.append(pull * scale + penalty * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column score."""
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.table()
        wanted = weight != 0
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for low, high, owner, bucket in _present(batch.column(at), wanted):
                z[low:high] += np.bincount(owner, weight[bucket], minlength=high - low)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*batch.schema.names, "score"])

    return map_arrow(docs, score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op4_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = fit(labelled_sample(docs, labels, "toxic", sample))
    out = scored(with_text(docs).select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, unchanged; a text that is null stays null."""
    model = fit(labelled_sample(docs, labels, "toxic", sample))
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = scored(docs.toDF(*names), model, names[docs.columns.index("text")]).filter(F.col("score") < limit)
    return kept.select(*names).toDF(*docs.columns)
