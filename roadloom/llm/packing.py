"""Best-fit packing of tokenised documents into training sequences: vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces go, longest
first, to the open sequence that scores best among those that hold them under every capacity: the least weighted norm of
what would be left, or the largest weighted dot product of need and room. As pieces of one length are alike, the packing
runs on the counts by length: at most max_tokens rows come to the driver, whatever the corpus, and it gives slots, each
a range of ranks among the pieces of a length with a range of sequences and an offset. A piece then finds its slot by
its rank, by halving the list of its length's slots. Only documents longer than a sequence are cut; the first piece has the remainder.

A null text counts as empty and gives one piece, the end token. A repeated row is a document of its own. A null doc_id is
an id like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .shared import map_arrow, n_buckets, prefix_within, with_text, written

MAX_TOKENS = 2048
MAX_DOCUMENTS = 2048
MAX_ATTENTION = MAX_TOKENS * MAX_TOKENS
WEIGHTS = (1.0, 1e-3, 1e-3)
END_ID = 0
COMMON = 0x250
LONG_RUN = 10_000
#: Fixed value: contractions, then runs of letters, numbers or others, each with one space before it, then space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(whole) -> dict[bytes, int] | None:
    """The ids of a byte-level tokenizer by their bytes, if merging the neighbours whose joined bytes have the least id always
    gives what its list of merges gives. That holds if ids rise along the merges, each longer token comes of one merge, and each
    token is what its own bytes are encoded to: two neighbours that tile a token's bytes are a state of encoding these bytes
    alone, as no merge has crossed their ends; its last state of two is the merge that makes the token, so no other pair of
    neighbours ever joins to it. All of this is checked here, token by token."""
    import json

    shape = json.loads(whole.to_str())
    split, model = shape.get("pre_tokenizer") or {}, shape["model"]
    plain = (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False) and model.get("type") == "BPE"
    if not plain or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or any(shape.get(x) for x in ("normalizer", "truncation", "padding")):
        return None
    vocabulary, table = model["vocab"], byte_of()
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(vocabulary) or sum(len(t) == 1 for t in vocabulary) != 256:
        return None
    tokens = list(vocabulary)
    if any([t.id for t in whole.model.tokenize(t)] != [vocabulary[t]] for t in tokens):
        return None
    return {bytes(table[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Texts to ids (as bytes, little-endian, 4 each) by the tokenizer file. Where ranks_of shows that merging by ids gives the
    same, texts of characters below COMMON, whose classes Unicode has fixed, are merged so, which takes a quarter of the time.
    Texts with other characters, with added tokens or with very long runs go through the tokenizer itself."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        ranks = ranks_of(self.whole)
        self.merged = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^\\x00-{chr(COMMON - 1)}]", *added]))
        self.long = re.compile(rf"(?<!\S)\S{{{LONG_RUN}}}|(?<!\s)\s{{{LONG_RUN}}}")

    def encode(self, text: str) -> bytes:
        if self.merged is None or self.other.search(text) or (len(text) >= LONG_RUN and self.long.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.merged.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(1)
def encoder(tokenizer_file: str) -> Encoder:
    """One a worker process."""
    return Encoder(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row a piece; with keep_ids also its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from roadloom.llm import packing  # the worker's own module, which keeps the encoder

        for batch in batches:
            _, begins = textnp.text_bytes(batch.column(1))
            for low, high in textnp.chunks(begins, 1 << 20):
                part = batch.slice(low, high - low)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), map(packing.encoder(tokenizer_file).encode, part.column(1).to_pylist()), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    many = len(ids) // 4
                    edges = [0, *range((many - 1) % max_tokens + 1, many + 1, max_tokens)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), *([np.frombuffer(ids, "<u4")[a:b].tolist()] if keep_ids else [])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if keep_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(with_text(docs).select(F.col("doc_id").cast("long"), "text"), cut, PIECES + (", ids array<long>" if keep_ids else ""))


def slots(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION, weights=WEIGHTS, rule: str = "norm") -> pd.DataFrame:
    """length, low, high, sequence, offset: pieces of that length with ranks from low to before high stand at offset in
    the sequences from `sequence` on. Bins that are alike are held as one row with a count."""
    capacity = np.array([max_tokens, max_documents, max_attention], dtype=np.float64)
    weight = np.asarray(weights, dtype=np.float64)
    first = np.empty(0, np.int64)  # first sequence, how many, and what is used in each
    many = np.empty(0, np.int64)
    used = np.empty((0, 3), np.int64)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, need = int(counts[length]), 0, np.array([length, 1, length * length], dtype=np.int64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        room = (capacity.astype(np.int64) - used) // need
        copies = room.min(axis=1, initial=np.iinfo(np.int64).max)
        fits = np.flatnonzero(copies > 0)
        rest = (capacity - used[fits]) / capacity
        score = -(weight * rest * (need / capacity)).sum(axis=1) if rule == "dot" else (weight * (rest - need / capacity) ** 2).sum(axis=1)
        new_first, new_many, new_used = [], [], []

        def place(at: int, bins: int, each: int, before: np.ndarray) -> None:
            nonlocal rank, left
            for j in range(each):
                out.append((length, rank, rank + bins, at, int(before[0]) + j * length))
                rank += bins
            left -= bins * each
            new_first.append(at)
            new_many.append(bins)
            new_used.append(before + need * each)

        for g in fits[np.argsort(score, kind="stable")]:
            if left == 0:
                break
            each, before = int(copies[g]), used[g].copy()
            whole = min(int(many[g]), left // each)
            if whole:
                place(int(first[g]), whole, each, before)
                first[g] += whole
                many[g] -= whole
            if 0 < left < each and many[g]:
                place(int(first[g]), 1, left, before)
                first[g] += 1
                many[g] -= 1
        if left:
            each, none = int((capacity.astype(np.int64) // need).min()), np.zeros(3, np.int64)
            for bins, copies_each in ((left // each, each), (1, left % each)):
                if bins and copies_each:
                    place(opened, bins, copies_each, none)
                    opened += bins
        keep = many > 0
        first = np.concatenate([first[keep], np.array(new_first, np.int64)])
        many = np.concatenate([many[keep], np.array(new_many, np.int64)])
        used = np.concatenate([used[keep], np.array(new_used, np.int64).reshape(-1, 3)])
        open_still = used[:, 0] < max_tokens
        first, many, used = first[open_still], many[open_still], used[open_still]
    return pd.DataFrame(out, columns=["length", "low", "high", "sequence", "offset"]).astype("int64")


def pack(cut: DataFrame, **how) -> DataFrame:
    """cut (a table that can be read again, with length and what tells its rows apart) plus sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = slots(counts, **how)
    # the slots depend on the lengths that occur, at most max_tokens, not on the number of documents
    by_length = found.sort_values(["length", "low"]).groupby("length").agg(list).reset_index()
    table = F.broadcast(spark.createDataFrame(by_length, "length long, low array<long>, high array<long>, sequence array<long>, offset array<long>").withColumnsRenamed({"low": "_low", "sequence": "_sequence", "offset": "_at"}).drop("high"))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets(sum(counts.values()))))
    ranked = prefix_within(cut.withColumn("_deal", deal).withColumn("_one", F.lit(1).cast("long")), ["length"], ["_deal"], ["doc_id", "piece", "ids_crc32"], "_one", "_rank")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(int(by_length.low.map(len).max()).bit_length() if len(by_length) else 1))])
    slot = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get("_low", at + step) <= F.col("_rank"), F.lit(False)), at + step).otherwise(at))
    placed = ranked.join(table, "length").withColumn("_slot", slot)
    return placed.withColumn("sequence_id", F.get("_sequence", F.col("_slot")) + F.col("_rank") - F.get("_low", F.col("_slot"))).withColumn("offset", F.get("_at", F.col("_slot"))).select(*cut.columns, "sequence_id", "offset")


def op10_pack_sequences(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    return pack(written(pieces(docs, tokenizer_file), "pieces"))
