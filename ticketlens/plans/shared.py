"""Reliable checkpoints, and prefix sums over groups of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset on a local master (tests, a laptop) a fresh temporary folder is made; a
    cluster without one is an error, since a folder of the driver's own machine would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _shuffles_go(spark: SparkSession):
    """Shuffle files of the jobs that run inside go with the job, not when the driver's memory is cleaned; a later read would make them anew."""
    return _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through files in the shared folder; survives lost executors.

    The frame keeps the size that the planner had guessed for its plan. Iterations must use ``stored``: a guess
    that is built on the guess of the round before grows without bound.
    """
    shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    """A path and its file system, which need not be the driver's own disk."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _passing(spark: SparkSession, path: str) -> None:
    """A folder that is there goes when the application ends."""
    place, system = _place(spark, path)
    system.deleteOnExit(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    _passing(spark, path)
    return path


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and the planner knows its true size.

    The folder goes when the application ends, or earlier by ``forget``. Whole texts that are read once or twice take less room with zstd.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path, compression=codec)
    _passing(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; other frames and None are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            place, system = _place(df.sparkSession, path)
            system.delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "16m"):
    """Jobs that run inside hand Python workers batches of at most ``rows`` rows and about ``size`` bytes."""
    return _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size})


def prefix_sum(df: DataFrame, by: list[str], value: Column, order: list[str], out: str, chunk: Column) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that come before.

    Rows are ordered by ``chunk``, then ``order``. A key may hold any share of the rows: each
    (key, chunk) is summed by itself, and the chunks' totals are summed in a second, small pass.
    ``order`` must be unique within a key, or ties must be rows that are interchangeable.
    """
    df = df.withColumn("_chunk", chunk).withColumn("_value", value.cast("long"))
    keys = [*by, "_chunk"]
    totals = df.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(totals, on, "left").withColumn(out, F.col("_inside") + F.col("_base"))
    return joined.drop("_chunk", "_value", "_inside", "_base", *[f"_k{i}" for i in range(len(keys))])


def chunks_for(rows: int, per_chunk: int = 20_000) -> int:
    return max(1, -(-rows // per_chunk))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the 0-based place of each row in an order, without one window over all rows.

    Spark's range partitioner deals the rows into parts of about equal size, whatever the values
    are; rows equal in ``order`` stay together, so ``order`` should tell them apart where they may be many.
    """
    parts = chunks_for(df.count())
    ranged = checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    return prefix_sum(ranged, [], F.lit(1), order, out, F.col("_part")).drop("_part")


#: A key with more than this share of the rows is spread over SPREAD tasks; there are at most 1 / HOT_SHARE of them.
HOT_SHARE, SPREAD, HOT_ROWS = 0.001, 64, 1_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a key, by a key that any share of ``left`` may hold.

    Keys over ``HOT_SHARE`` of the rows are found by a count that is summed before it moves. Their
    rows are salted by a hash of the whole row, their rows of ``right`` repeated for each salt, so a key of
    any size is split over tasks. Null keys never match. ``counts`` (key, _k) says how many rows of ``left`` each
    key that matters has; without it ``left`` is read twice and should be a stored table.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_k")) if counts is None else counts
    counts = counts.filter(F.col(key).isNotNull())
    total, most = counts.agg(F.coalesce(F.sum("_k"), F.lit(0)), F.coalesce(F.max("_k"), F.lit(0))).first()
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if most <= least:
        return left.join(right, key, how)
    hot = stored(counts.filter(F.col("_k") > least).select(key, F.lit(True).alias("_hot")))
    columns = left.columns
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
