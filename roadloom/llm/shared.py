"""Helpers that the corpus operators share: tables, checkpoints written as Parquet, let-bindings, prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as the contracts spell it: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where none is set, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roadloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back. A lost executor costs no recomputation
    of what stands before, and what reads the table more than once sees the same rows each time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/roadloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver has it from."""
    context = spark.sparkContext
    if getattr(context, "_roadloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        archive = Path(tempfile.mkdtemp()) / "roadloom-src.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, Path(top.name) / file.relative_to(top))
        context.addPyFile(str(archive))
    context._roadloom_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow where function sees slices of about BATCH_BYTES (or one row, if that is longer) whatever size the session's
    batches have; what a batch has used is given back before the next. A session whose batches have the default of rows gets
    smaller ones, as the JVM holds a batch too; results don't depend on it."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        from roadloom.llm.textnp import release

        def slices():
            for batch in batches:
                many = max(1, min(batch.num_rows, BATCH_BYTES * batch.num_rows // max(batch.nbytes, 1)))
                for low in range(0, batch.num_rows, many):
                    part = batch.slice(low, many)
                    if many > 1 and part.nbytes > 4 * BATCH_BYTES:  # a few long texts among short ones
                        yield from (part.slice(k, 1) for k in range(part.num_rows))
                    else:
                        yield part

        for out in function(slices()):
            yield out
            release()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str], function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that written() gave."""
    spark, total = df.sparkSession, 0
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, or a little more."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(0).cast("long")) + 16
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 16
    return F.lit(8)


def memory_bytes(df: DataFrame, most: int) -> int:
    """Bytes that the rows of a written table take in memory, however well its files are compressed; if the files alone
    exceed `most`, their size."""
    packed = table_bytes(df)
    if packed > most:
        return packed
    return int(df.agg(F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(32)))).first()[0] or 0)


def sized(table: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A written table with a broadcast hint if its rows are that small in memory; a larger one is joined by shuffle."""
    return F.broadcast(table) if memory_bytes(table, most) <= most else table


def drop_written(spark: SparkSession | None = None) -> None:
    """Deletes the tables that written() has left; results that were not stored must not be read afterwards."""
    for session, path in [x for x in _written if spark is None or x[0] is spark]:
        _written.remove((session, path))
        try:
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return


atexit.register(drop_written)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def with_text(docs: DataFrame, col: str = "text") -> DataFrame:
    """A null text counts as an empty one."""
    return docs.withColumn(col, F.coalesce(F.col(col), F.lit("")))


def shielded(rows: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """rows with all columns but the needed ones renamed, so that no name can clash, and what gives the names back."""
    inner = {c: c if c in needed else f"_other{i}" for i, c in enumerate(rows.columns)}
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), lambda df: df.select(*[F.col(n).alias(c) for c, n in inner.items()])


def key_of(col: str) -> Column:
    """A string that never is null and tells null from every value: join and partition keys compare plainly."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("-"))


def held_out() -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def prefix_within(df: DataFrame, part: Sequence[str], bucket: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """out: the sum of value (a long) over the rows that stand before a row within its part, in the order of the bucket
    columns, then of the order columns. No part is sorted in one task: each (part, bucket) is summed by itself, and only
    the sums of buckets, one row each, meet by part. Choose buckets so that both stay small. part and bucket hold no nulls."""
    keys = [*part, *bucket]
    before = Window.partitionBy(*part).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, keys).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def n_buckets(rows: int) -> int:
    """Buckets for prefix_within over so many rows: the root of their number, so that buckets and rows in one grow alike."""
    return max(1, int(rows**0.5 / 8))
