"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are found by pattern: values assigned to names such as password, access keys, long hexadecimal runs. The
values of base spans and other long tokens that mix letters and digits are candidates. The corpus is the judge of a candidate:
its hash is counted over distinct repositories (a text is one; its copies within an owner are forks of it and count once) and
distinct owners (the source). A value that OWNERS or more owners have, or that stands in REPOSITORIES or more, is a copied
example; a rarer one looks like a live credential of its owner. The scan adds spans of kind `owned`: live-looking tokens that
are either the value of a base span elsewhere, or at least OWNED_CHARS long with digits and letters of both cases. A token may
overlap base spans that are part of it; it is left out where a base span covers it, or all but a short name before an assigned
value. Base spans always stay; counts of live and example values tell them apart. Masking replaces each stretch that reported
spans cover, overlapping ones as one, by position, so no character of a reported span is left.

Positions count code points. As SQL gives matches without positions, a text is also split at the matches: the lengths of
gaps and matches sum up to positions, in blocks, so texts with very many matches take near linear time. Masking cuts a text
into blocks likewise and takes each gap from the blocks it lies in.

Null texts count as empty, null sources are an owner of their own. Repeated rows are reported and masked each, and count as
one repository. Of overlapping spans the mark is that of a live one if any is. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import key_of, let, memory_bytes, shielded, with_text, written

#: Fixed by the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX = "[0-9a-f]{%d,}" % LEAST["hex"]  # shorter runs are dropped anyway
KINDS = ("assign", "access", "hex", "owned")

TOKEN = r"[A-Za-z0-9+/_.=-]{12,}"
OWNED_CHARS = 20
OWNERS = 3
REPOSITORIES = 25
#: An assigned value may have a name of fewer characters than a token's before it, as in my_password=...
NAME_CHARS = 12
BLOCK = 256
#: Characters of a block that masking takes gaps from.
CUT = 1024
LIVE, EXAMPLE = "[secret]", "[example]"
#: Whatever has a span matches this; most texts don't.
SUSPECT = ASSIGN + r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12}"
#: Masks of up to so many bytes in memory go to every task; more are joined by shuffle with the suspect texts.
SHIPPED = 64 << 20


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The fold by step (of numbers from 0 on, associative) up to each place of an array."""
    none = F.array().cast("array<int>")
    run = lambda part: F.aggregate(part, none, lambda a, v: F.concat(a, F.array(step(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)), v))))
    total = lambda part: F.aggregate(part, F.lit(0), step)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    placed = lambda p: let(F.concat(F.array(F.lit(0)), run(F.transform(p, total))), lambda before: F.flatten(F.transform(p, lambda part, i: F.transform(run(part), lambda v: step(v, before[i])))))
    return let(values, lambda a: let(blocks(a), placed))


def spans(text: Column, pattern: str, kind: int, value: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """An array of (start, kind, end, value's hash, whether a token is varied) of the matches that are kept, by start."""
    shape = "array<struct<start:int,kind:int,end:int,value:bigint,varied:boolean>>"

    def found(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        one = lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.when(keep(hit), F.xxhash64(value(hit))).alias("value"), (F.lit(kind == 3) & _varied(hit)).alias("varied"))
        return F.filter(F.zip_with(hits, running(lengths), one), lambda s: s["value"].isNotNull()).cast(shape)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(~F.exists(hits, keep), F.array().cast(shape)).otherwise(found(hits)))


def _assigned(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 2)


def _mixed(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def _varied(token: Column) -> Column:
    return (F.length(token) >= OWNED_CHARS) & token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


#: Pattern, value and test of each kind, in order. Runs of hexadecimal digits are tried with their least length at once.
RULES = (
    (ASSIGN, _assigned, lambda h: F.length(_assigned(h)) >= LEAST["assign"]),
    (ACCESS, lambda h: h, lambda h: F.length(h) >= LEAST["access"]),
    (HEX, lambda h: h, lambda h: F.length(h) >= LEAST["hex"]),
    (TOKEN, lambda h: h, _mixed),
)


def row_key(owner: str) -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.col(owner))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, _key, _owner, _repo, base and tokens (arrays of spans) of each row, written. The patterns share their
    characters, so a base span that covers a token, or its value, ends where the token ends; at most one of each kind does."""
    found = [spans(F.col("text"), pattern, k, value, keep) for k, (pattern, value, keep) in enumerate(RULES)]
    rows = with_text(docs).select("doc_id", row_key(owner).alias("_key"), key_of(owner).alias("_owner"), F.xxhash64("text").alias("_repo"), F.concat(*found[:3]).alias("base"), found[3].alias("tokens"))
    both = F.array_sort(F.transform(F.concat("base", "tokens"), lambda s: F.struct(s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start"), s["value"].alias("value"), s["varied"].alias("varied"))))

    def covered(marks: Column, x: Column, i: Column) -> Column:
        before = [F.get(marks, i - back) for back in (1, 2, 3)]
        own = [(b["end"] == x["end"]) & (b["start"] - x["start"] < F.when(b["kind"] == 0, NAME_CHARS).otherwise(1)) for b in before]
        return F.coalesce(own[0], F.lit(False)) | F.coalesce(own[1], F.lit(False)) | F.coalesce(own[2], F.lit(False))

    apart = lambda m: F.filter(m, lambda x, i: (x["kind"] == 3) & ~covered(m, x, i))
    free = F.transform(let(both, apart), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["varied"].alias("varied")))
    return written(rows.withColumn("tokens", F.when(F.size("tokens") > 0, free).otherwise(F.col("tokens"))), "spans")


def verdicts(scanned: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """value, known, repositories, owners, copied of each candidate's hash. A repository's copies are merged first, then
    an owner's repositories are counted, so a value that a third of all documents hold comes to its sum as one row a task and
    repository, then as one row an owner."""
    one = F.explode(F.array_distinct(F.concat(F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("known"))), F.transform("tokens", lambda s: F.struct(s["value"].alias("value"), F.lit(False).alias("known"))))))
    rows = scanned.filter(F.size("base") + F.size("tokens") > 0).select("_owner", "_repo", one.alias("c")).select("_owner", "_repo", "c.value", "c.known")
    forks = rows.groupBy("value", "_owner", "_repo").agg(F.max("known").alias("known"))
    by_owner = forks.groupBy("value", "_owner").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("repositories"))
    counted = by_owner.groupBy("value").agg(F.max("known").alias("known"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    return written(counted.withColumn("copied", (F.col("owners") >= owners) | (F.col("repositories") >= repositories)), "verdicts")


def judged(scanned: DataFrame, **limits) -> DataFrame:
    """_key, examples, live, rare: the hashes of a document's values by verdict (of tokens only those of known values are live)."""
    values = F.explode(F.array_distinct(F.transform(F.concat("base", "tokens"), lambda s: s["value"])))
    rows = scanned.filter(F.size("base") + F.size("tokens") > 0).select("_key", values.alias("value"))
    copied = F.col("copied")
    sets = rows.join(verdicts(scanned, **limits), "value").groupBy("_key").agg(F.collect_set(F.when(copied, F.col("value"))).alias("examples"), F.collect_set(F.when(~copied & F.col("known"), F.col("value"))).alias("live"), F.collect_set(F.when(~copied, F.col("value"))).alias("rare"))
    return written(sets, "judged")


def found_spans(scanned: DataFrame, sets: DataFrame) -> DataFrame:
    """scanned with all spans, sorted, and how many base values are live or examples."""
    none = F.array().cast("array<bigint>")
    rows = scanned.join(sets, "_key", "left").select("doc_id", "_key", "base", "tokens", *[F.coalesce(c, none).alias(c) for c in ("examples", "live", "rare")])
    added = F.filter("tokens", lambda s: F.array_contains("live", s["value"]) | (F.array_contains("rare", s["value"]) & s["varied"]))
    return rows.withColumn("base", F.array_sort("base")).withColumn("all", F.array_sort(F.concat("base", added))).withColumn("n_examples", F.size(F.filter("base", lambda s: F.array_contains("examples", s["value"]))).cast("long"))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(docs: DataFrame) -> DataFrame:
    scanned = scan(docs)
    rows = found_spans(scanned, judged(scanned))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_examples", (F.size("base") - F.col("n_examples")).alias("n_live"))


def masks(found: DataFrame) -> DataFrame:
    """_key and masks (start, end, live) of the documents with spans, one row each: spans that overlap or touch are one."""
    spanned = found.filter(F.size("all") > 0).dropDuplicates(["_key"])
    marked = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (~F.array_contains("examples", s["value"])).alias("live")))

    def clusters(s: Column, ends: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(-1)).alias("before"))), lambda h: h["start"] > h["before"])
        one = lambda h, low, after: F.struct(
            low["start"].alias("start"), F.coalesce(after["before"], F.element_at(ends, -1)).alias("end"), F.exists(F.slice(s, low["i"] + 1, F.coalesce(after["i"], F.size(s)) - low["i"]), lambda x: x["live"]).alias("live")
        )
        return let(heads, lambda h: F.transform(h, lambda low, k: one(h, low, F.get(h, k + 1))))

    merged = let(marked, lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda ends: clusters(s, ends)))
    return written(spanned.select("_key", merged.alias("masks")), "masks")


def masked(text: Column, cover: Column) -> Column:
    """text with each stretch of cover (an array of start, end, live; apart and by start) replaced by its mark."""

    def gap(blocks: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / CUT).cast("int"), F.floor((high - 1) / CUT).cast("int")
        return F.when(high <= low, "").otherwise(F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), low - first * CUT + 1, high - low))

    def joined(blocks: Column, m: Column) -> Column:
        parts = F.flatten(F.transform(m, lambda x, k: F.array(gap(blocks, F.coalesce(F.get(m, k - 1)["end"], F.lit(0)), x["start"]), F.when(x["live"], LIVE).otherwise(EXAMPLE))))
        return F.concat(F.array_join(parts, ""), gap(blocks, F.element_at(m, -1)["end"], F.length(text)))

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0)), lambda blocks: let(cover, lambda m: joined(blocks, m)))


def redacted(docs: DataFrame, owner: str = "source", shipped: int = SHIPPED, **limits) -> DataFrame:
    """docs with all reported spans masked: live ones and copied examples by a mark of their own. Texts without any stay as
    they are; n_chars, if there, is counted anew where a text has changed. Masks that are few in bytes go to every task, so no
    text is shuffled; beyond, only texts that the patterns suspect are joined by shuffle."""
    docs, restored = shielded(docs, ("doc_id", "text", owner, "n_chars"))
    scanned = scan(docs, owner)
    cover = masks(found_spans(scanned, judged(scanned, **limits)))

    def changed(rows: DataFrame, side: DataFrame) -> DataFrame:
        rows = rows.withColumn("_key", row_key(owner)).join(side, "_key", "left")
        rows = rows.withColumn("text", F.when(F.col("masks").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("masks"))))
        if "n_chars" in docs.columns:
            rows = rows.withColumn("n_chars", F.when(F.col("masks").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
        return rows.select(*docs.columns)

    if memory_bytes(cover, shipped) <= shipped:
        return restored(changed(docs, F.broadcast(cover)))
    suspect = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
    return restored(docs.filter(~suspect).unionByName(changed(docs.filter(suspect), cover)))


_POSITIONS = """list_transform(range(1, len({h}) + 1), lambda i: {{'start': list_sum(list_transform({g}[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform({h}[1:i - 1], lambda x: length(x)))::bigint, 0), 'hit': {h}[i]}})"""


def oracle() -> str:
    """The same scan in SQL: values themselves instead of their hashes."""
    parts, picks = [], []
    for k, (pattern, _, _) in enumerate(RULES):
        quoted = pattern.replace("'", "''")
        parts.append(f"regexp_extract_all(t, '{quoted}', 0) as h{k}, string_split_regex(t, '{quoted}') as g{k}")
        picks.append(f"select r, {k} as kind, unnest({_POSITIONS.format(h=f'h{k}', g=f'g{k}')}) as m from cut")
    assign = ASSIGN.replace("'", "''")
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as owner, coalesce(text, '') as t from documents),
cut as (select r, {', '.join(parts)} from docs),
hits as ({' union all '.join(picks)}),
valued as (
  select r, kind, m.start as s, m.start + length(m.hit) as e,
         case when kind = 0 then regexp_extract(m.hit, '{assign}', 2) else m.hit end as v
  from hits),
kept as (
  select * from valued
  where case kind when 0 then length(v) >= 6 when 1 then length(v) >= 20 when 2 then length(v) >= 24
        else regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') end),
spans as (
  select * from kept a
  where kind < 3 or not exists (
    select 1 from kept b where b.r = a.r and b.e = a.e and ((b.kind = 0 and b.s - a.s < {NAME_CHARS}) or (b.kind in (1, 2) and b.s <= a.s)))),
seen as (select distinct d.t, d.owner, s.v, s.kind < 3 as known from spans s join docs d using (r)),
verdict as (
  select v, bool_or(known) as known, count(distinct owner) >= {OWNERS} or count(distinct (owner, t)) >= {REPOSITORIES} as copied
  from seen group by v),
told as (
  select s.*, w.copied,
         kind < 3 or (not w.copied and (w.known or (length(v) >= {OWNED_CHARS} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')))) as shown,
         (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || s || ':' || e as name
  from spans s join verdict w using (v)),
per as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(name, ',' order by s, kind) filter (kind < 3) as base, string_agg(name, ',' order by s, kind) filter (shown) as spans,
         count(*) filter (kind < 3 and copied) as n_examples, count(*) filter (kind < 3 and not copied) as n_live
  from told group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_examples, 0)::bigint as n_examples, coalesce(n_live, 0)::bigint as n_live
from docs left join per using (r)
"""
