"""Quality rules with cross-document line frequency, in DataFrame operations only.

Rules on a text alone count words, symbols, repeated lines and words in repeated windows. The method is the corpus's: lines
are normalised (case, digits, white space) and hashed, and counted over the distinct texts of each host (the source). A
line that more than LEAST_DOCS texts of its host hold, and more than ROOT times the root of the number of its texts, is
boilerplate and is removed; a text that keeps less than KEPT of its words is depleted and rejected. Copies of a text count
once, so copies alone make no boilerplate. The limit grows with the host, but slowly: what is common to some hundreds of a
million texts goes.

Texts are read once; what stays are line hashes and counts, written, with a number for each row, so repeated rows are
judged each. Null texts have no words and fail the rules. A null source is a host of its own. Repeated windows are found by
sorting numbers that hold a hash and a place, and windows that agree there count if their words are the same. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import key_of, let, sized, with_text, words, written

SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
LEAST_DOCS = 20
ROOT = 0.5
KEPT = 0.3


def repeated_words(found: Column) -> Column:
    """How many words of an array lie in windows of three that occur twice or more."""

    def covered(places: Column) -> Column:
        return let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), F.lit(0), lambda a, v: a + v.cast("int")))

    def pairs(same: Callable[[Column, Column], Column], far: int) -> Callable[[Column], Column]:
        """Which of an array are the same as one of their neighbours, up to so far."""
        return lambda s: F.filter(s, lambda x, k: reduce(Column.__or__, [F.coalesce(same(F.get(s, k + d), x), F.lit(False)) for d in range(-far, far + 1) if d]))

    def found_twice(hashes: Column, bits: Column) -> Column:
        key = lambda x: F.call_function("shiftright", x, bits)
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        marked = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)), bits).bitwiseOR(i.cast("long")))
        equal = lambda a, b: (key(a) == key(b)) & reduce(Column.__and__, [F.get(found, place(a) + j) == F.get(found, place(b) + j) for j in range(3)])
        alike = let(F.sort_array(marked), pairs(lambda a, b: key(a) == key(b), 1))
        return covered(F.transform(let(alike, pairs(equal, 2)), place))

    hashed = F.transform(found, lambda w: F.xxhash64(w))
    counted = let(hashed, lambda h: let(F.ceil(F.log2(F.size(h))).cast("int"), lambda bits: found_twice(h, bits)))
    return F.when(F.size(found) < 3, F.lit(0)).otherwise(counted).cast("long")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row each: base counts, and the hash and words of each line; written."""
    text = F.col("text")
    line = lambda t: F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, "[0-9]", "0"), BLANK, " ")))
    full = F.filter(F.split(text, "\n", -1), lambda t: t.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(full, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), F.transform(a, lambda t: F.struct(F.xxhash64(line(t)).alias("line"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))).alias("lines")))
    rows = with_text(docs).select("doc_id", key_of(host).alias("_host"), F.xxhash64(text).alias("_text"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return written(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_host", "_text", "w.*", "l.*", "n_symbols"), "lines")


def boilerplate(rows: DataFrame, least_docs: int = LEAST_DOCS, root: float = ROOT) -> DataFrame:
    """_host, line of the lines above the limits; written."""
    lines = rows.select("_host", "_text", F.explode(F.array_distinct(F.transform("lines", lambda s: s["line"]))).alias("line"))
    counted = lines.groupBy("_host", "line", "_text").agg(F.lit(1)).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > least_docs)
    sizes = rows.groupBy("_host", "_text").agg(F.lit(1)).groupBy("_host").agg(F.count(F.lit(1)).alias("texts"))
    return written(written(counted, "counted").join(written(sizes, "hosts"), "_host").filter(F.col("docs") > F.lit(root) * F.sqrt(F.col("texts").cast("double"))).select("_host", "line"), "boilerplate")


def judged(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, root: float = ROOT, kept: float = KEPT) -> DataFrame:
    rows = measured(docs, host)
    common = sized(boilerplate(rows, least_docs, root))
    lines = rows.select("_row", "_host", F.explode("lines").alias("l")).select("_row", "_host", "l.line", "l.words")
    lost = lines.join(common, ["_host", "line"]).groupBy("_row").agg(F.sum("words").alias("n_removed_words"))
    out = rows.join(lost, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * F.lit(kept)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def op9_line_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce('=' || source, '-') as host, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
spread as (select r, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
wins as (select r, i, a, lead(a) over o as b, lead(a, 2) over o as c from spread window o as (partition by r order by i)),
twice as (select r, unnest([i, i + 1, i + 2]) as i from (select r, i, count(*) over (partition by r, a, b, c) as n from wins where c is not null) where n > 1),
rep as (select r, count(distinct i) as n from twice group by r),
lines as (select r, unnest(string_split(t, chr(10))) as raw from d),
full_lines as (select r, raw, trim(lower(regexp_replace(regexp_replace(raw, '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) as line,
               len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as n from lines where regexp_matches(raw, '[^\x20\x09-\x0D]')),
dups as (select r, count(*) - count(distinct raw) as n from full_lines group by r),
hosts as (select host, count(distinct t) as texts from d group by host),
common as (select host, line from full_lines join d using (r) join hosts using (host) group by host, line, texts
           having count(distinct t) > {LEAST_DOCS} and count(distinct t) > {ROOT}::double * sqrt(texts::double)),
lost as (select r, sum(n) as n from full_lines join d using (r) join common using (host, line) group by r),
m as (
  select doc_id, len(ws)::bigint as n_words, length(list_aggregate(ws, 'string_agg', ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dups.n, 0)::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_removed_words
  from d join w using (r) left join rep using (r) left join dups using (r) left join lost using (r)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - n_removed_words >= n_words * {KEPT}::double as kept, n_removed_words
from f
"""
