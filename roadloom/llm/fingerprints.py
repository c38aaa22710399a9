"""Document fingerprints by one-permutation MinHash with optimal densification and packed bits, in DataFrame operations only.

A text's shingles (runs of five words; a shorter text is one shingle) are hashed once. The hash names one of BINS bins and a
value; a bin keeps its least value. An empty bin takes the value of the first filled bin in a sequence of its own, which is
the same for all texts, so two texts agree on it as likely as on a filled one. Of each value the low BITS bits are stored,
one hexadecimal digit a bin. Two fingerprints agree by chance in one of 2**BITS bins, and the likeness is corrected for it:
(share of equal bins - 2**-BITS) / (1 - 2**-BITS), at least 0.

Defined results: a text without words (null, empty, white space) has the empty fingerprint; two such are alike with 1, and
with other texts with 0. Documents stand in order of doc_id, null first, then of text; a row that repeats id and text is the
same document, with the same result. The last document's next is the first; a single document is its own next. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, with_text, words, written

SHINGLE = 5
BINS = 256
BITS = 4
VALUE_BITS = 47
PROBES = 24
_NONE = (1 << VALUE_BITS) - 1
_draw = random.Random(20_260_101)
#: Where each bin's sequence of bins starts, and its odd step: with BINS a power of two it comes by every bin.
_START = [_draw.randrange(BINS) for _ in range(BINS)]
_STEP = [_draw.randrange(BINS // 2) * 2 + 1 for _ in range(BINS)]


def _ints(values: list[int], kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def shingles(text: Column) -> Column:
    def runs(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, long).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def sketch(text: Column) -> Column:
    """The stored digits, one a bin, as an array of tinyint; empty for a text without words."""
    low = (1 << BITS) - 1
    marks = lambda s: F.concat(F.transform(s, lambda h: F.shiftrightunsigned(h, 64 - VALUE_BITS - 8)), _ints([(b << VALUE_BITS) | _NONE for b in range(BINS)], "bigint"))
    value = lambda x: x.bitwiseAND(_NONE)
    firsts = lambda s: F.filter(s, lambda x, k: (k == 0) | (F.shiftright(F.get(s, k - 1), VALUE_BITS) != F.shiftright(x, VALUE_BITS)))

    def densified(m: Column) -> Column:
        filled = F.filter(m, lambda x: value(x) != _NONE)
        stored = F.transform(m, lambda x: F.when(value(x) != _NONE, x.bitwiseAND(low).cast("int")))
        # beyond PROBES steps the order of a hash of both bins goes on; it is the same for all texts as well
        rest = lambda f, i: F.array_min(F.transform(f, lambda x: F.shiftleft(F.shiftrightunsigned(F.xxhash64(i, F.shiftright(x, VALUE_BITS)), BITS + 1), BITS).bitwiseOR(x.bitwiseAND(low)))).bitwiseAND(low).cast("int")

        def fill(d: Column, f: Column) -> Column:
            step = lambda i, j: F.get(d, (F.get(F.col("_start"), i) + j * F.get(F.col("_step"), i)).bitwiseAND(BINS - 1))
            return F.transform(d, lambda v, i: F.coalesce(v, *[step(i, j) for j in range(PROBES)], rest(f, i)).cast("tinyint"))

        return let(F.struct(stored.alias("d"), filled.alias("f")), lambda b: fill(b["d"], b["f"]))

    dense = lambda s: let(F.array_sort(marks(s)), lambda o: let(firsts(o), densified))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), dense(shingles(text))).otherwise(F.array().cast("array<tinyint>"))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    named = df.columns
    return df.withColumn("_start", _ints(_START, "int")).withColumn("_step", _ints(_STEP, "int")).withColumn(out, sketch(F.col(text))).select(*named, out)


def packed(digits: Column) -> Column:
    return F.array_join(F.transform(digits, lambda v: F.lower(F.hex(v.cast("long")))), "")


def likeness(a: Column, b: Column) -> Column:
    chance = 2.0**-BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.lit(float(BINS))
    alike = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(alike)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the sketch of each row."""
    return with_sketch(with_text(docs).select("doc_id", "text"), "text", "sketch").select("doc_id", "sketch")


def neighbours(docs: DataFrame) -> DataFrame:
    """For each document: id, _text (a hash), code points, sketch and the same of the document before it, in a circle. Only
    ids, lengths and sketches move: they are dealt out by ranges of the id, written with the number of the range, ordered
    within each range, and the ends of ranges, one row a range, meet to bridge them."""
    rows = written(with_sketch(docs, "text", "sketch").select("id", "_text", F.length("text").cast("long").alias("n"), "sketch"), "sketches")
    ranged = rows.repartitionByRange("id", "_text").withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges").dropDuplicates(["_range", "id", "_text"])
    one = F.struct("id", "_text", "n", "sketch")
    last = ranged.groupBy("_range").agg(F.max(F.struct("id", "_text", "n")).alias("last"))
    last = last.join(ranged.select("_range", F.struct("id", "_text", "n").alias("last"), "sketch"), ["_range", "last"]).select("_range", F.struct("last.id", "last._text", "last.n", "sketch").alias("last"))
    circle = last.select("_range", F.coalesce(F.lag("last").over(Window.orderBy("_range")), F.max_by("last", "_range").over(Window.partitionBy())).alias("_carried"))
    before = F.lag(one).over(Window.partitionBy("_range").orderBy("id", "_text"))
    return written(ranged.withColumn("_before", before).join(F.broadcast(circle), "_range").select("id", "_text", "n", "sketch", F.coalesce("_before", "_carried").alias("before")), "neighbours")


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    """Of each text and of the text with its second half replaced by the start of the next document. Texts are dealt out
    once, by id (both joins ask for the same columns, so they share the exchange); of the next document only the part that
    is used follows to its predecessor."""
    least = -(1 << 63)
    rows = with_text(docs).select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.xxhash64("text").alias("_text"))
    links = neighbours(rows)
    half = F.floor(F.col("before.n") / 2).cast("int")
    nexts = rows.join(links, ["id", "_text"]).select(F.col("before.id").alias("id"), F.col("before._text").alias("_text"), F.substring(F.col("text"), F.lit(1), half).alias("part"), F.col("before.sketch").alias("sketch"), likeness(F.col("before.sketch"), F.col("sketch")).alias("near_next"), F.col("doc_id").alias("next_id"))
    if rows.count() > links.count():  # repeated rows
        nexts = nexts.dropDuplicates(["id", "_text"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("part"))
    out = rows.join(nexts, ["id", "_text"]).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "near_next", "next_id")
    out = with_sketch(out, "edited", "other")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("sketch")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("other")).alias("near_edited"), "near_next", "next_id")
