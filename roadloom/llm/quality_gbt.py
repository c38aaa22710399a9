"""Quality: histogram gradient-boosted trees over document statistics.

The statistics of a text (shares of character classes, lengths of words and lines, repeated words, runs and lines) are
computed batch by batch with numpy. Each is cut into at most BINS bins at quantiles of the training rows; trees of a
fixed depth grow level by level on sums of gradients by bin. A tree is flattened into arrays by heap order (the children
of node i are 2i+1 and 2i+2), so all rows step down all trees with one gather a level. It learns from at most SAMPLE
labelled rows (by a hash of the id, never from held-out rows); only their statistics, some numbers a row, are collected.

Null texts count as empty, and empty texts have all-zero statistics and so a score. Rows of labels without id or label
are left out; of repeated labels for an id the largest counts. Repeated rows are scored each. With one class only, or no
labels, every score is that class's share (0 with none). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .shared import held_out, map_arrow, with_text
from .toxicity import labelled_sample

SAMPLE = 16_000
BINS = 64
DEPTH = 5
TREES = 80
RATE = 0.12
LEAST_WEIGHT = 1.0
RIDGE = 1.0

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "stop": b".,;:",
    "quote": b"\"'()[]{}",
    "at": b"@/\\_=+-",
    "high": range(128, 256),
    "space": [32, *range(9, 14)],
}
NAMES = [*_CLASSES, "log_bytes", "log_words", "log_lines", "word_mean", "word_sd", "word_max", "line_mean", "words_distinct", "top_word", "same_as_last", "same_as_before_last", "pairs_repeated", "runs_repeated", "lines_repeated", "upper_words", "odd_words"]


def statistics(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n, sizes = len(begins) - 1, np.diff(begins)
    per = np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), sizes)
    columns = []
    for bytes_of in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(bytes_of)] = True
        columns.append(np.bincount(owner[table[data]], minlength=n) / per)
    starts, ends, firsts = textnp.word_spans(data, begins)
    counts = np.diff(firsts)
    some = np.maximum(counts, 1)
    text = np.repeat(np.arange(n), counts)
    lengths = (ends - starts).astype(np.float64)
    words = textnp.span_hashes(textnp.lower(data), starts, ends)
    mean = np.bincount(text, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(text, lengths * lengths, n) / some - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, text, lengths)
    breaks = np.bincount(owner[data == 10], minlength=n)

    def repeated(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, how many distinct keys it has and how often the commonest occurs."""
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((keys, of))
        k, o = keys[order], of[order]
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
        most = np.zeros(n)
        np.maximum.at(most, o[new], np.diff(np.append(new, len(k))))
        return np.bincount(o[new], minlength=n), most

    distinct, most = repeated(words, text)

    def lagged(lag: int) -> np.ndarray:
        same = (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag]) if len(words) > lag else np.zeros(0, bool)
        return np.bincount(text[lag:][same], minlength=n) / some if len(words) > lag else np.zeros(n)

    def runs(size: int) -> np.ndarray:
        if len(words) < size:
            return np.zeros(n)
        own = text[size - 1 :] == text[: len(text) - size + 1]
        keys = words[: len(words) - size + 1].copy()
        for j in range(1, size):
            keys = textnp.mixed(keys + words[j : len(words) - size + 1 + j])
        found, _ = repeated(keys[own], text[: len(own)][own])
        total = np.bincount(text[: len(own)][own], minlength=n)
        return 1 - found / np.maximum(total, 1) * (total > 0) - (total == 0)

    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([begins[:-1], cut + 1, begins[1:]]))
    line_starts, line_ends = edges[:-1], edges[1:]
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_text = np.searchsorted(begins, line_starts, "right") - 1
    line_kinds, _ = repeated(textnp.span_hashes(data, line_starts, line_ends), line_text)
    lines = np.bincount(line_text, minlength=n)
    upper = np.zeros(256, bool)
    upper[65:91] = True
    capital = np.bincount(text, upper[data[starts]] & upper[data[np.minimum(starts + 1, ends - 1)]] & (lengths > 1), n) / some
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256), *b".,"]] = True
    odd = np.bincount(text, ~letters[data[ends - 1]], n) / some if len(ends) else np.zeros(n)
    columns += [np.log1p(sizes), np.log1p(counts), np.log1p(breaks), mean, spread, longest, counts / np.maximum(lines, 1), distinct / some, most / some, lagged(1), lagged(2), runs(2), runs(3), 1 - line_kinds / np.maximum(lines, 1) - (lines == 0), capital, odd]
    return np.stack(columns, axis=1)


def features(column: pa.Array) -> np.ndarray:
    data, begins = textnp.text_bytes(column)
    parts = [statistics(data[begins[a] : begins[b]], begins[a : b + 1] - begins[a]) for a, b in textnp.chunks(begins)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Forest:
    """Trees as arrays [tree, node]: the statistic and the limit it is held against; leaves hold values of the last level."""

    column: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.column))
        z = np.empty(len(x))
        for low in range(0, len(x), 4096):
            part = x[low : low + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[rows, self.column[trees, node]] > self.limit[trees, node])
            z[low : low + 4096] = self.bias + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    inner, leaves, n_columns = 2**DEPTH - 1, 2**DEPTH, x.shape[1]
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(n_columns)]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], "left") for j in range(n_columns)])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    bias, z = float(np.log(share / (1 - share))), np.zeros(len(y))
    column, limit, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-(bias + z)))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best, kept = np.full(width, 1e-6), np.full(width, -1, np.int64)
            cut = np.zeros(width, np.int64)
            total_g, total_h = np.bincount(node - first, g, width), np.bincount(node - first, h, width)
            for j in range(n_columns):
                at, bins = (node - first) * BINS + binned[j], width * BINS
                left_g = np.bincount(at, g, bins).reshape(width, BINS).cumsum(axis=1)
                left_h = np.bincount(at, h, bins).reshape(width, BINS).cumsum(axis=1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
                gain[:, len(limits[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better], kept[better], cut[better] = gain[np.arange(width), top][better], j, top[better]
            for k in np.flatnonzero(kept >= 0):
                column[t, first + k], limit[t, first + k] = kept[k], limits[kept[k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), column[t, node]] > limit[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        z += value[t, leaf]
    return Forest(column, limit, value, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features(batch.column(2)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = map_arrow(labelled_sample(docs, labels, "quality", sample).select("doc_id", "y", "text"), measure, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = rows.y.to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        flat = np.zeros((1, 2**DEPTH - 1))
        return Forest(flat.astype(np.int64), flat, np.zeros((1, 2**DEPTH)), 40.0 if len(y) and y[0] else -40.0)
    return grow(np.array(rows.x.tolist()), y)


def op1_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    forest = train(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(features(batch.column(1))))], names=["doc_id", "score"])

    out = map_arrow(with_text(docs).select(F.col("doc_id").cast("long"), "text"), score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
