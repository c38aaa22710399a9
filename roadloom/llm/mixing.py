"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies, the same for all documents of a source: the source's target over its
size. Within a source the documents stand in order of size; the expected copies are summed up in that order, one random
offset is added for the source, and a document is emitted once for each integer that its stretch of the sum crosses. As
neighbours are alike in size, the words taken stay near the target, and each document's chance is its expected copies; no document comes more often than its expected
copies rounded up. The sums are whole numbers of 2**-24 copies, so they are exact in any order and reruns agree.

Null texts have size 0; the null source is a source of its own, last in order. A repeated row is a document of its own,
with its own copies. Documents of size 0 are sampled like others and take 0 words. A null doc_id is an id like others.
An empty table gives an empty result. Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import key_of, n_buckets, n_words, prefix_within, shielded, sized, with_text, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"
ONE = 1 << 24


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.col("source"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words; _row tells texts under one id apart."""
    return with_text(docs).select("doc_id", "source", n_words(F.col("text")).alias("size"), key_of("source").alias("_source"), row_key().alias("_row"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: its size, documents and target. The share of all sizes is dealt by weight; no target exceeds cap
    times its source's size, and the excess goes to the others by weight. With the sources in order of cap over weight, the
    level a unit of weight gets if all before are capped rises as long as that is so, then falls; its peak holds for all.
    These windows run over one row a source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("_ratio", "_source").rowsBetween(Window.unboundedPreceding, -1)
    per = sized.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0))
    heavy = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(by_level), F.lit(0.0))
    per = per.withColumn("_level", left / heavy)
    target = F.least(F.col("_cap"), F.col("_weight") * F.max("_level").over(every))
    return per.select("_source", "source_size", "_docs", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs."""
    sized = written(sizes(docs), "sizes")
    per = written(targets(sized, weights, share, cap), "targets")
    rows = per.agg(F.max("_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    digits = F.col("size").cast("string")
    # size to two digits, then a hash: even a source of equal sizes is spread over many buckets
    spread = sized.join(per, "_source").select(
        "*",
        rate.alias("_rate"),
        (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("_class"),
        F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(n_buckets(rows))).alias("_deal"),
    )
    summed = written(prefix_within(spread, ["_source"], ["_class", "_deal"], ["size", "doc_id", "_row"], "_rate", "_before"), "summed")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_source"))), 1, 8), 16, 10).cast("long") % ONE
    copies = F.shiftright(F.col("_before") + F.col("_rate") + F.col("_offset"), 24) - F.shiftright(F.col("_before") + F.col("_offset"), 24)
    return summed.withColumn("_offset", offset).withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_row")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in id, text and source share their copies."""
    docs, restored = shielded(docs, ("doc_id", "text", "source"))
    taken = mix(docs, **how).groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_same"))
    taken = written(taken, "copies")
    counts = sized(written(taken.filter("_copies > 0").select("_row", "_copies"), "counts"))
    rows = docs.withColumn("_row", row_key())
    if (taken.agg(F.max("_same")).first()[0] or 0) > 1:
        rows = rows.dropDuplicates(["_row"])
    return restored(rows.join(counts, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def op5_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
with sized as (
  select doc_id, source, case when source is null then '-' else '=' || source end as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
per as (select k, min(source) as source, sum(size)::bigint as source_size, count(*) as docs from sized group by k),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from per),
capped as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / w as ratio from weighed),
levels as (
  select *, ((select sum(source_size)::double from per) * 1.5::double - coalesce(sum(cap) over b, 0.0::double))
            / ((select sum(w) from capped) - coalesce(sum(w) over b, 0.0::double)) as lvl
  from capped window b as (order by ratio, k rows between unbounded preceding and 1 preceding)),
aimed as (select k, source_size, least(cap, w * (select max(lvl) from levels)) as target from levels),
b as (select greatest(1, floor(sqrt((select max(docs) from per)) / 8))::bigint as n),
dealt as (
  select s.*, a.source_size, a.target,
         case when a.source_size > 0 then round(a.target / a.source_size * 16777216)::bigint else 0 end as rate,
         length(s.size::varchar) * 100 + substr(s.size::varchar, 1, 2)::int as cls,
         ('0x' || substr(md5(coalesce(s.doc_id::varchar, '')), 1, 8))::bigint % (select n from b) as deal
  from sized s join aimed a using (k)),
summed as (
  select *, coalesce(sum(rate) over (partition by k order by cls, deal, size, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from dealt),
drawn as (select *, ('0x' || substr(md5('mix' || k), 1, 8))::bigint % 16777216 as o from summed)
select doc_id, size, source_size, target, (((before + rate + o) >> 24) - ((before + o) >> 24))::bigint as copies,
       ((((before + rate + o) >> 24) - ((before + o) >> 24)) * size)::bigint as taken
from drawn
"""
