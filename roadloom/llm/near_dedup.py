"""Near-duplicate classes by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of five words, each labelled with how often it has occurred before, so labelled k-mers
are distinct. A sketch takes, for each of many hash functions, the ELL labelled k-mers of least hash and keeps them in
the order in which they stand in the text; two texts agree on one with a likelihood that falls with their edit distance,
not only with the k-mers they share. ROWS sketches make a band, and texts that agree on a band are candidates.

Links are found in three passes; the first two are quick and join nearly all that belongs together, the third is exact.
First each member of a band's group is a candidate of three leaders of its group: the most central
one, one drawn in proportion to centrality (another in each band), and the least id. Central is a text whose groups are
large: of many edited copies that are near to their original but not to one another, the original. Texts that are copies
of one another are one node from the start. First each node goes to its most central leader of all bands; then every pair
of a node and one of its leaders that still lie in different classes is verified. Last, every other pair of one group whose
nodes still lie in different classes is decided, so the classes are those of the graph of all pairs that share a band. No
group, partner or candidate is capped. Groups of one class are done by then. Small groups give their pairs; of a larger group
the nodes are dealt to blocks, those of a large class by themselves, and a task decides a pair of blocks: it counts the k-mers
that two texts share, by products of matrices, and aligns those that share enough. Its work grows with the pairs of different
classes that a group holds, its memory does not.

Verification aligns the two texts: the longest common subsequence of their labelled k-mers within the band of diagonals
that an alignment of the wanted likeness cannot leave. As labelled k-mers are distinct, that is the longest increasing
run of matched positions, found in n log n. Likeness is aligned k-mers over all k-mers of both (a Jaccard index that
heeds order); LIKENESS or more is a link. Classes are joined by rounds of least-neighbour labels, in tables.

Defined results: a null text counts as empty; all empty texts are copies of one another. A text of fewer than five words is
one k-mer. Rows that repeat an id are in one class; rows with a null id are left out of matching, and their class is null.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .shared import map_arrow, map_groups, sized, with_text, written

SHINGLE = 5
LIKENESS = 0.8
ELL = 2
ROWS = 2
BANDS = 24
SMALL = 16  # members of a group that gives its pairs
BLOCK = 128  # texts, and k-mers, of a block of a larger group, on average
BLOCK_KMERS = 1 << 19
_SEEDS = textnp.mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each hash mixed with the number of equal ones before it."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    if len(first) == len(ranked):
        return shingles
    nth = np.empty(len(ranked), np.uint64)
    nth[order] = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    return np.where(nth > 0, textnp.mixed(shingles + nth * np.uint64(0xA24BAED4963EE407)), shingles)


def kmers(words: np.ndarray) -> np.ndarray:
    return labelled(textnp.shingle_hashes(words, SHINGLE))


def band_keys(marks: np.ndarray) -> np.ndarray:
    """A key for each band of a text's labelled k-mers."""
    ell = min(ELL, len(marks))
    kept = np.empty((len(_SEEDS), ell), np.uint64)
    for low in range(0, len(_SEEDS), max(1, (1 << 18) // max(1, len(marks)))):
        seeds = _SEEDS[low : low + max(1, (1 << 18) // max(1, len(marks)))]
        # a multiply-shift hash of marks that are well mixed already
        hashes = (marks[None, :] ^ (seeds >> np.uint64(7))[:, None]) * seeds[:, None]
        hashes ^= hashes >> np.uint64(32)
        least = np.argmin(hashes, axis=1)
        rows = np.arange(len(seeds))
        found = [least]
        for _ in range(ell - 1):
            hashes[rows, found[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            found.append(np.argmin(hashes, axis=1))
        kept[low : low + len(seeds)] = marks[np.sort(np.stack(found, axis=1), axis=1)]
    sketch = np.zeros(len(_SEEDS), np.uint64)
    for j in range(ell):
        sketch = textnp.mixed(sketch + kept[:, j])
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = textnp.mixed(key + sketch.reshape(BANDS, ROWS)[:, j])
    return key.view(np.int64)


def texts_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words of each text."""
    data, begins = textnp.text_bytes(column)
    for a, b in textnp.chunks(begins):
        part = textnp.lower(data[begins[a] : begins[b]])
        starts, ends, firsts = textnp.word_spans(part, begins[a : b + 1] - begins[a])
        words = textnp.span_hashes(part, starts, ends)
        yield from (words[x:y] for x, y in zip(firsts[:-1], firsts[1:], strict=True))


def aligned(a: np.ndarray, b: np.ndarray, likeness: float = LIKENESS) -> float:
    """The likeness of two texts by their labelled k-mers, or 0 where it is below the wanted one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    need = likeness * (len(a) + len(b)) / (1 + likeness)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < need - 1e-9:
        return 0.0
    width = len(a) + len(b) - 2 * need  # unmatched k-mers that are allowed bound how far a match leaves the diagonal
    near = np.abs(at_a - at_b) <= width + 1e-9
    order = np.argsort(at_a[near], kind="stable")
    ends: list[int] = []
    for position in at_b[near][order].tolist():
        at = bisect_left(ends, position)
        if at == len(ends):
            ends.append(position)
        else:
            ends[at] = position
    found = len(ends) / (len(a) + len(b) - len(ends))
    return found if found >= likeness - 1e-12 else 0.0


def sketches(texts: DataFrame) -> DataFrame:
    """node, size, keys: how many k-mers each text has, and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [kmers(w) for w in texts_words(batch.column(1))]
            keys = [band_keys(m).tolist() if len(m) else [0] * BANDS for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in marks], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "keys"])

    return map_arrow(texts.select("node", "text"), sketch, "node long, size long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """The pairs (node, other) whose texts are alike enough, with their likeness."""
    named = texts.select(F.col("node").alias("other"), F.col("text").alias("other_text"))
    both = pairs.join(texts.select("node", "text"), "node").join(named, "other").select("node", "other", "text", "other_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [aligned(kmers(x), kmers(y), likeness) for x, y in zip(texts_words(batch.column(2)), texts_words(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["node", "other", "likeness"])

    return map_arrow(both, verify, "node long, other long, likeness double").filter("likeness > 0")


def shared_kmers(marks: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many labelled k-mers each two texts share."""
    text = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    _, column, many = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    text, column = text[many[column] > 1], column[many[column] > 1]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    column = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
    out = np.zeros((len(marks), len(marks)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(marks), width), np.float32)
        held[text[a:b], column[a:b] - low] = 1
        out += held @ held.T
    return out


def block_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, marks: list[np.ndarray], likeness: float) -> list[tuple[int, int, float]]:
    """The links between texts of two sides (of one, if there is one) that lie in different classes; two that have come
    into one class by an earlier link are not aligned."""
    sizes = np.array([len(m) for m in marks])
    enough = shared_kmers(marks) >= likeness * (sizes[:, None] + sizes[None, :]) / (1 + likeness) - 1e-9
    ahead = sides[:, None] < sides[None, :] if sides.any() else np.arange(len(nodes))[:, None] < np.arange(len(nodes))[None, :]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(enough & ahead & (roots[:, None] != roots[None, :])).tolist():
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b and (found := aligned(marks[i], marks[j], likeness)) > 0:
            parent[max(a, b)] = min(a, b)
            out.append((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j])), found))
    return out


def remaining(members: DataFrame, root: DataFrame, held: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """The links (node, other, likeness) between members of one group that lie in different classes and were not held
    against each other; written."""
    rows = written(members.join(root, "node", "left").select("band", "key", "many", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rows.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band", "key")
    rows = written(rows.join(sized(written(mixed, "mixed")), ["band", "key"]), "open")
    few = rows.filter(F.col("many") <= SMALL).select("band", "key", "node", "size", "root")
    named = few.select("band", "key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"))
    alike = F.least("size", "other_size") >= F.greatest("size", "other_size") * F.lit(likeness) - 1e-6
    pairs = few.join(named, ["band", "key"]).filter((F.col("node") > F.col("other")) & (F.col("root") != F.col("other_root")) & alike)
    pairs = written(pairs.select("node", "other").distinct().join(held, ["node", "other"], "left_anti"), "pairs")
    links = verified(pairs, texts, likeness)
    large = rows.filter(F.col("many") > SMALL)
    if large.isEmpty():
        return written(links, "links")
    parts = F.greatest(F.ceil(F.col("texts") / BLOCK), F.ceil(F.col("kmers") / BLOCK_KMERS))
    by_root = written(large.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("kmers")), "by-root")
    is_big = (F.col("texts") > BLOCK // 2) | (F.col("kmers") > BLOCK_KMERS // 2)
    big = sized(written(by_root.filter(is_big).select("band", "key", "root", parts.alias("own_parts")), "big"))
    rest = by_root.filter(~is_big).groupBy("band", "key").agg(F.sum("texts").alias("texts"), F.sum("kmers").alias("kmers"))
    rest = sized(written(rest.select("band", "key", parts.alias("parts")), "rest"))
    dealt = large.join(big, ["band", "key", "root"], "left").join(rest, ["band", "key"], "left")
    owner = F.when(F.col("own_parts").isNotNull(), F.col("root").cast("string")).otherwise("")
    bucket = F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("own_parts", "parts"))
    dealt = written(dealt.select("band", "key", "node", "root", owner.alias("owner"), F.concat(owner, F.lit(":"), bucket.cast("string")).alias("block")), "dealt")
    blocks = written(dealt.select("band", "key", "owner", "block").distinct(), "blocks")
    second = blocks.select("band", "key", F.col("owner").alias("second_owner"), F.col("block").alias("second"))
    tasks = blocks.withColumnRenamed("block", "first").join(second, ["band", "key"]).filter("first <= second and (owner = '' or owner <> second_owner)")
    tasks = sized(written(tasks.select("band", "key", "first", "second"), "tasks"))
    sides = [dealt.withColumnRenamed("block", name).join(tasks, ["band", "key", name]) for name in ("first", "second")]
    sides = [side.select("band", "key", "first", "second", "node", "root", F.lit(k).alias("side")) for k, side in enumerate([sides[0], sides[1].filter("first <> second")])]
    whole = written(sides[0].union(sides[1]), "sides").join(texts.select("node", "text"), "node")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"])
        marks = [kmers(w) for w in texts_words(pa.array(pdf.text, pa.string()))]
        found = block_links(pdf.node.to_numpy(), pdf.root.to_numpy(), pdf.side.to_numpy(), marks, likeness)
        return pd.DataFrame(found, columns=["node", "other", "likeness"])

    return written(links.union(map_groups(whole, ["band", "key", "first", "second"], decide, "node long, other long, likeness double")), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the links the least node it is linked to, over any number of steps. Each round turns
    the links of a node towards its least neighbour and halves the depth; the tables shrink to stars."""
    links = written(links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).filter("node <> other").distinct(), "links")
    while True:
        # large star: larger neighbours go to the least neighbour; small star: so do the smaller ones
        both = links.union(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = written(both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least")), "least")
        large = both.filter(F.col("other") > F.col("node")).join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = written(large.filter("node <> other").distinct(), "stars")
        least = written(large.groupBy("node").agg(F.min("other").alias("least")), "least")
        small = large.join(least, "node").select(F.when(F.col("other") == F.col("least"), F.col("node")).otherwise(F.col("other")).alias("node"), F.col("least").alias("other"))
        small = written(small.filter("node <> other").distinct(), "stars")
        roots = small.select(F.col("other").alias("node")).distinct()
        # done when each node has one neighbour below it and no root has any
        if small.groupBy("node").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").isEmpty() and small.join(roots, "node", "left_semi").isEmpty():
            return small.select("node", F.col("other").alias("root"))
        links = small


def classes(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """doc_id, class_id, copies, links for each row: the least id of its class, how many rows have its very text, and to
    how many of the texts that it was held against it is linked."""
    rows = with_text(docs).select(F.col("doc_id").cast("long"), "text")
    known = rows.filter("doc_id is not null")
    marked = written(known.select("doc_id", F.md5("text").alias("digest")), "digests")
    same = written(marked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "copies")
    ids = written(marked.join(same, "digest").select("doc_id", "node", "copies"), "ids")
    # every text is sketched where it is read; only sketches, not texts, are then held against the copies
    nodes = ids.filter("doc_id = node").select("node").distinct()
    texts = known.withColumnRenamed("doc_id", "node")
    keyed = written(sketches(texts).join(nodes, "node", "left_semi"), "sketches")
    bands = keyed.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = written(bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "groups")
    members = written(bands.join(shared, ["band", "key"]), "members")
    central = written(members.groupBy("node").agg(F.sum("many").alias("score")), "scores")
    members = written(members.join(central, "node"), "members")
    drawn = F.col("score") * (F.pmod(F.xxhash64("band", "node"), F.lit(1_000_003)) + 1)
    most = lambda by: F.max_by(F.struct("node", "score"), F.struct(by, -F.col("node")))
    least = F.min_by(F.struct("node", "score"), "node")
    leaders = written(members.groupBy("band", "key").agg(F.array(most(F.col("score")), most(drawn), least).alias("leaders")), "leaders")
    led = members.join(leaders, ["band", "key"]).select("node", F.explode("leaders").alias("leader")).filter("node <> leader.node").distinct()
    led = written(led.select("node", F.col("leader.node").alias("other"), "leader.score"), "led")
    pair = (F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    pairs = written(led.select(*pair).distinct(), "pairs")
    nearest = led.groupBy("node").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("other")).select(*pair).distinct()
    nearest = written(nearest, "nearest")
    in_pairs = sized(written(pairs.select(F.explode(F.array("node", "other")).alias("node")).distinct(), "in-pairs"))
    wanted = written(texts.join(in_pairs, "node", "left_semi"), "texts")
    again = ids.filter("doc_id <> node").select(F.col("doc_id").alias("node"), F.col("node").alias("other"))
    first = written(verified(nearest, wanted, likeness), "links")
    found = first.select("node", "other")
    root = components(found)
    to = lambda column: root.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    apart = pairs.join(nearest, ["node", "other"], "left_anti").join(to("node"), "node", "left").join(to("other"), "other", "left")
    apart = apart.filter(F.coalesce("node_root", "node") != F.coalesce("other_root", "other")).select("node", "other")
    second = written(verified(apart, wanted, likeness), "links")
    links = first.union(second)
    root = written(components(links.select("node", "other").union(again)), "roots")
    third = remaining(members, root, pairs, wanted, likeness)
    if not third.isEmpty():
        links = links.union(third)
        root = components(root.select("node", F.col("root").alias("other")).union(third.select("node", "other")))
    links = links.groupBy("node", "other").agg(F.max("likeness").alias("likeness"))
    degree = links.select(F.explode(F.array("node", "other")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    linked = sized(written(root.join(degree, "node", "full"), "linked"))
    out = ids.join(linked, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    none = rows.select("doc_id").filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return out.unionByName(none)


def without_near_copies(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The row of least id of each class, and rows with a null id; of rows that repeat an id, one."""
    found = classes(docs, likeness).filter("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("many"))
    found = written(found, "kept")
    gone = sized(written(found.filter("doc_id <> class_id").select("doc_id"), "gone"))
    rows = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.filter("many > 1").isEmpty():
        return rows
    return rows.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(rows.filter("doc_id is null"))


def op8_near_dedup(docs: DataFrame) -> DataFrame:
    return classes(docs)
