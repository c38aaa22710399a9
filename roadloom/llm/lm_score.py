"""Document scores by masked pseudo-likelihood: a bidirectional window network in numpy predicts every word from both sides.

Every word has a leaf of a tree of two levels, CLASSES by MEMBERS. The FREQUENT commonest words of the corpus have leaves of
their own, by rank; any other word has the leaf of its first and last byte. Leaves are inputs and outputs alike. For a masked
word the network adds an embedding of each of the two words before and after it (one table a place) and bends the sum by
tanh; a softmax gives the class, and with an embedding of the class added to the same sum a second one gives the member. So
every word's leaf is predicted from both sides. Within the leaf of a rare word its spelling counts: the bytes' bigram model
over the corpus, divided by the mass that model gives to all words of that first and last byte, which is summed in closed form
by a matrix inverse. A document's score is the sum of the conditional log probabilities of all its words.

Training reads every position of every document, where the documents lie: each task walks through its split in chunks, from
the same start, and gives one set of weights; the sets are averaged, weighed by windows, by some at a time. First a round
over one document in WARM, by a hash, to start from, then one over all. Nothing is dealt by text, so copies or long texts meet nowhere; a task holds a
chunk of a few hundred kilobytes, or one text, and one set of weights. More documents make more splits, not larger ones.

Null texts count as empty: no words, a sum of 0 and a null mean. Repeated rows are scored each; as training windows they count
as often as they stand there. An empty table gives an empty result. Other columns are ignored. Weights depend on how the table
is split, so scores repeat for the same files and settings, and differ a little for others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .shared import map_arrow, map_groups, with_text, written

CLASSES = MEMBERS = 64
LEAVES = CLASSES * MEMBERS
FREQUENT = 3072
EDGE = LEAVES  # beyond either end of a text, and a place that a model does not look at
BOUNDARY = 255  # before and after a word's bytes; UTF-8 has no such byte
SIDE = 2
PLACES = (*range(-SIDE, 0), *range(1, SIDE + 1))
WIDTH = 16
WARM = 16
BATCH = 2048
STEP = 0.1
AT_ONCE = 16
_SHAPES = [(len(PLACES) * (EDGE + 1), WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH), (WIDTH, MEMBERS), (CLASSES, MEMBERS)]
_SIZE = sum(math.prod(s) for s in _SHAPES)


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    """Embeddings by place, bend, class weights and biases, class embeddings, member weights, member biases by class."""
    out, at = [], 0
    for shape in _SHAPES:
        out.append(flat[at : at + math.prod(shape)].reshape(shape))
        at += math.prod(shape)
    return out


def start_weights() -> np.ndarray:
    return np.random.default_rng(7).normal(0, 0.1, _SIZE).astype(np.float32)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of texts: its range, bytes, starts, ends of words, and where each text's words begin."""
    data, begins = textnp.text_bytes(column)
    for low, high in textnp.chunks(begins):
        part = data[begins[low] : begins[high]]
        yield low, high, part, *textnp.word_spans(part, begins[low : high + 1] - begins[low])


def counted(docs: DataFrame) -> DataFrame:
    """kind, key, n over all documents: of words (0, by hash) and of pairs of neighbouring bytes, BOUNDARY at either end (1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, pairs = [np.zeros(0, np.uint64)], np.zeros(1 << 16, np.int64)
            for _, _, data, starts, ends, _ in _words(batch.column(0)):
                hashes.append(textnp.span_hashes(data, starts, ends))
                pairs += np.bincount(_pairs(data, starts, ends)[1], minlength=1 << 16)
            keys, n = np.unique(np.concatenate(hashes).view(np.int64), return_counts=True)
            some = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(keys), len(some)]).astype(np.int32)), pa.array(np.concatenate([keys, some])), pa.array(np.concatenate([n, pairs[some]]))], names=["kind", "key", "n"])

    return written(map_arrow(docs.select("text"), count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of neighbouring bytes, ends included, its word and its code."""
    sizes = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    if not len(word):
        return word, np.zeros(0, np.int64)
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(len(word)) + np.repeat(starts - firsts, sizes)
    after = data[np.minimum(at, len(data) - 1)].astype(np.int64)
    after[firsts + sizes - 1] = BOUNDARY
    before = data[np.maximum(at - 1, 0)].astype(np.int64)
    before[firsts] = BOUNDARY
    return word, before << 8 | after


def edge_masses(chain: np.ndarray) -> np.ndarray:
    """What a bigram chain over bytes gives to all words of each first and last byte: the sum over the words' lengths."""
    left, out = np.eye(BOUNDARY) - chain[:BOUNDARY, :BOUNDARY], np.eye(BOUNDARY)
    for k in range(BOUNDARY):  # the diagonal dominates, so no pivots are sought; plain loops need no threads of the driver
        out[k] /= left[k, k]
        left[k] /= left[k, k]
        factor = left[:, k].copy()
        factor[k] = 0
        out -= factor[:, None] * out[k]
        left -= factor[:, None] * left[k]
    return chain[BOUNDARY, :BOUNDARY, None] * out * chain[None, :BOUNDARY, BOUNDARY]


class Vocabulary:
    """Which leaf a word has, and its log probability within it; fixed in size, as it goes to every task."""

    def __init__(self, counts: DataFrame):
        top = counts.filter("kind = 0").orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
        pairs = counts.filter("kind = 1").toPandas()  # at most 2**16 rows
        order = np.argsort(top.key.to_numpy(), kind="stable")
        self.keys = top.key.to_numpy()[order].astype(np.int64)
        self.rank = order.astype(np.int64)
        table = np.full((256, 256), 0.1)
        table[BOUNDARY, BOUNDARY] = 0
        table.reshape(-1)[pairs.key.to_numpy()] += pairs.n.to_numpy()
        chain = table / table.sum(axis=1, keepdims=True)
        mass = edge_masses(chain)
        by_mass = np.argsort(-mass.reshape(-1), kind="stable")
        leaf = np.full(BOUNDARY * BOUNDARY, LEAVES - 1)
        leaf[by_mass[: LEAVES - FREQUENT - 1]] = np.arange(FREQUENT, LEAVES - 1)
        self.edge_leaf = leaf.reshape(BOUNDARY, BOUNDARY).astype(np.int16)
        held = np.bincount(leaf, mass.reshape(-1), LEAVES)
        self.leaf_mass = np.log(np.maximum(held, 1e-300))
        self.spelling = np.log(np.maximum(chain, 1e-300)).astype(np.float32).reshape(-1)

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes = textnp.span_hashes(data, starts, ends).view(np.int64)
        out = self.edge_leaf[np.minimum(data[starts], BOUNDARY - 1), np.minimum(data[ends - 1], BOUNDARY - 1)].astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            out[known] = self.rank[at[known]]
        return out

    def spelled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log probabilities of rare words within their leaves."""
        word, code = _pairs(data, starts, ends)
        return np.bincount(word, self.spelling[code], len(starts)) - self.leaf_mass[leaf]


def contexts(leaf: np.ndarray, firsts: np.ndarray, places: Sequence[int] = PLACES) -> np.ndarray:
    """For each word the rows of the embedding tables around it; an edge where the text ends or a place is not looked at."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    out = np.full((len(leaf), len(PLACES)), EDGE, np.int64)
    for k, shift in enumerate(PLACES):
        if shift in places and len(leaf) > abs(shift):
            here, near = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
            out[here, k] = np.where(text[here] == text[near], leaf[near], EDGE)
    return out + np.arange(len(PLACES)) * (EDGE + 1)


def _miss(z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The loss's slope at the logits of a batch, over its mean: probabilities less what was wanted. Logits are sums of a few
    dozen terms below 1 by weights of a few units, so their exponentials need no shift."""
    np.exp(z, out=z)
    z *= 1 / (z @ np.ones(z.shape[1], z.dtype) * z.dtype.type(len(z)))[:, None]
    z[np.arange(len(z)), wanted] -= z.dtype.type(1 / len(z))
    return z


def sums(weights: list[np.ndarray], around: np.ndarray) -> np.ndarray:
    out = weights[0][around[:, 0]] + weights[1]
    for k in range(1, len(PLACES)):
        out += weights[0][around[:, k]]
    return out


def log_probabilities(weights: list[np.ndarray], around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Of each word's leaf, given the words around it."""
    _, _, to_class, class_bias, class_embed, to_member, member_bias = weights
    out, ones = np.empty(len(leaf)), np.ones(CLASSES, weights[0].dtype)
    for a in range(0, len(leaf), 2 * BATCH):
        pre, t = sums(weights, around[a : a + 2 * BATCH]), leaf[a : a + 2 * BATCH]
        group, rows = t // MEMBERS, np.arange(len(t))
        first = np.tanh(pre) @ to_class + class_bias
        second = np.tanh(pre + class_embed[group]) @ to_member + member_bias[group]
        own = first[rows, group] + second[rows, t % MEMBERS]
        out[a : a + 2 * BATCH] = own - np.log((np.exp(first, out=first) @ ones) * (np.exp(second, out=second) @ ones))
    return out


class Trainer:
    """Adagrad over windows, a batch at a time; embeddings change only where a batch has them."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32).copy()
        self.weights = unpacked(self.flat)
        self.squares = [np.full_like(w, 1e-3) for w in self.weights]

    def _move(self, k: int, grad: np.ndarray, rows=slice(None)) -> None:
        square = self.squares[k][rows] + grad * grad
        self.squares[k][rows] = square
        self.weights[k][rows] -= STEP * grad / np.sqrt(square)

    def step(self, around: np.ndarray, leaf: np.ndarray) -> None:
        _, _, to_class, class_bias, class_embed, to_member, member_bias = self.weights
        group = leaf // MEMBERS
        pre = sums(self.weights, around)
        first, second = np.tanh(pre), np.tanh(pre + class_embed[group])
        miss = _miss(first @ to_class + class_bias, group)
        own = _miss(second @ to_member + member_bias[group], leaf % MEMBERS)
        hot = np.zeros((CLASSES, len(leaf)), np.float32)
        hot[group, np.arange(len(leaf))] = 1
        second_back = (own @ to_member.T) * (1 - second * second)
        back = (miss @ to_class.T) * (1 - first * first) + second_back
        flat = around.reshape(-1).astype(np.uint16 if self.weights[0].shape[0] < 1 << 16 else np.int64)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        at = ranked[begins].astype(np.int64)
        embed = np.add.reduceat(back[order // len(PLACES)], begins, axis=0)
        grads = (back.sum(axis=0), first.T @ miss, miss.sum(axis=0), hot @ second_back, second.T @ own, hot @ own)
        self._move(0, embed, at)
        for k, grad in enumerate(grads, 1):
            self._move(k, grad)

    def learn(self, around: np.ndarray, leaf: np.ndarray, order: np.ndarray) -> None:
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            self.step(around[some], leaf[some])


def train(docs: DataFrame, words: Vocabulary, places: Sequence[int] = PLACES) -> np.ndarray:
    def averaged(parts: DataFrame) -> np.ndarray | None:
        """The mean of the tasks' weights: of AT_ONCE of them until one is left."""

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, total = pdf.sort_values("part"), np.zeros(_SIZE)
            for w, many in zip(pdf.weights, pdf.many, strict=True):
                total += np.frombuffer(w, np.float32).astype(np.float64) * many
            return pd.DataFrame({"part": [int(pdf.part.min()) // AT_ONCE], "many": [int(pdf.many.sum())], "weights": [(total / pdf.many.sum()).astype(np.float32).tobytes()]})

        while True:
            left = parts.agg(F.max("part")).first()[0]
            if left is None:
                return None
            parts = written(map_groups(parts.withColumn("_deal", F.floor(F.col("part") / AT_ONCE)), ["_deal"], lambda pdf: mean(pdf), "part long, many long, weights binary"), "weights")
            if left < AT_ONCE:
                return np.frombuffer(parts.first()["weights"], np.float32)

    start = start_weights()
    for every in (WARM, 1):
        begin = start

        def fit(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            trainer, many, rng = Trainer(begin), 0, np.random.default_rng(11)
            held: list[tuple] = []

            def learn() -> None:
                nonlocal many
                around, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                trainer.learn(around, leaf, rng.permutation(len(leaf)))
                many += len(leaf)

            for batch in batches:
                for _, _, data, starts, ends, firsts in _words(batch.column(0)):
                    leaf = words.read(data, starts, ends)
                    around = contexts(leaf, firsts, places)
                    held.append((around, leaf))
                    if sum(len(x) for _, x in held) >= BATCH:
                        learn()
            if held and sum(len(x) for _, x in held):
                learn()
            if many:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([many], pa.int64()), pa.array([trainer.flat.tobytes()], pa.binary())], names=["part", "many", "weights"])

        some = docs if every == 1 else docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
        found = averaged(written(map_arrow(some.select("text"), fit, "part long, many long, weights binary"), "fitted"))
        start = start if found is None else found
    return start


def score(docs: DataFrame, places: Sequence[int] = PLACES, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_prob (the sum), mean_log_prob of each row, by a model of docs or of learn_from that looks at places."""
    rows = with_text(docs).select(F.col("doc_id").cast("long"), "text")
    known = rows if learn_from is None else with_text(learn_from)
    words = Vocabulary(counted(known))
    flat = train(known, words, places)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unpacked(flat)
        for batch in batches:
            total, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for low, high, data, starts, ends, firsts in _words(batch.column(1)):
                leaf = words.read(data, starts, ends)
                each = log_probabilities(weights, contexts(leaf, firsts, places), leaf)
                rare = leaf >= FREQUENT
                each[rare] += words.spelled(data, starts[rare], ends[rare], leaf[rare])
                text = np.repeat(np.arange(high - low), np.diff(firsts))
                total[low:high] = np.bincount(text, each, high - low)
                many[low:high] = np.diff(firsts)
            mean = pa.array(np.where(many > 0, total / np.maximum(many, 1), np.nan), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(total), mean], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return map_arrow(rows, take, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def op3_lm_score(docs: DataFrame) -> DataFrame:
    return score(docs)
