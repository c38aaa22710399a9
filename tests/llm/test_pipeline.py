"""The stages one by one on a small corpus, against what each must do."""

import re

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import prose


def test_stages(spark, tmp_path):
    bad = lambda i: " grobianek " if i % 4 == 0 else " "
    rows = [(i, prose(i, 90) + bad(i) + prose(i + 9000, 20), "en", f"s{i % 3}") for i in range(160)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(1, 8)] + [(300, prose(300) + " password=abc123def456", "en", "s0"), (301, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    clean = {i for i in range(160) if i % 4} | {300, 301}
    assert clean <= ids("toxicity") and len(ids("toxicity") & {i for i in range(160) if i % 4 == 0}) <= 2
    assert not ids("near_dedup") & set(range(201, 208)) and clean <= ids("near_dedup")
    assert seen["secret_scan"].count() == seen["near_dedup"].count() and not [r for r in seen["secret_scan"].collect() if re.search("abc123def456", r.text or "")]
    sizes = lambda name: sum(len((r.text or "").split()) for r in seen[name].collect())
    assert abs(sizes("source_mix") / sizes("secret_scan") - 1.5) < 0.1
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_odd_rows_and_no_rows(spark, tmp_path, documents, labels):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns whose names stages use themselves."""
    for name, rows in (("odd", documents), ("none", documents.limit(0))):
        (tmp_path / name).mkdir()
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            function(spark, at, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{stage}")
            at = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            assert stage == "packing" or at.columns == documents.columns
            assert (at.count() == 0) == (name == "none")
        assert at.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_copies_and_mix_by_brute_force(spark, tmp_path, documents):
    """Which texts stay, and how often each is taken, by plain loops over the stages' inputs."""
    import hashlib
    from collections import defaultdict

    import pyarrow as pa

    from roadloom.llm import near_dedup

    rows = [(i, prose(i, 90), "en", f"s{i % 4}", 0) for i in range(60)] + [(100 + i, prose(i, 90) + (" more" if i % 2 else ""), "en", "s0", 0) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, str(tmp_path))
    marks = [near_dedup.kmers(w) for w in near_dedup.texts_words(pa.array([r[1] for r in rows]))]
    left = {r[0] for k, r in enumerate(rows) if not any(near_dedup.aligned(marks[j], marks[k]) for j in range(k))}
    assert {r.doc_id for r in kept.collect()} == left
    mixed = corpus_pipeline.mix_sources(spark, kept, str(tmp_path)).collect()
    by, sizes = defaultdict(list), defaultdict(int)
    for r in kept.collect():
        by[r.source].append((len(r.text.split()), r.doc_id))
        sizes[r.source] += len(r.text.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    open_, share, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        level = share / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        share -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 2 * max(by[s])[0] for s in sizes)
    again = corpus_pipeline.mix_sources(spark, kept, str(tmp_path)).collect()
    digest = lambda rows: hashlib.md5(repr(sorted(r.doc_id for r in rows)).encode()).hexdigest()
    assert digest(mixed) == digest(again)
