"""Consecutive numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What monotonically_increasing_id() leaves for the place within a partition.
_PLACE_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only in a local session that names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="bramble-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    # copies that nothing refers to any more are removed by Spark's cleaner
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column of 0, 1, 2, ... in the order, which should be total.

    Rows are range-partitioned and sorted; each partition's row count shifts the next
    ones' numbers. The sorted rows are checkpointed, since ranges are sampled anew at
    each execution. Only one count a partition is gathered.
    """
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = sorted((r.part, r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    shift, before = [], 0
    for p, n in counts:
        shift.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(shift or [(0, 0)], "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before")


def running_sum(df: DataFrame, name: str, value: Column, *order: Column) -> DataFrame:
    """df with the sum of value over all rows before each in the order: partial sums of ranges, then sums within them."""
    from pyspark.sql import Window

    rows = checkpoint(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], r.s) for r in rows.groupBy("_part").agg(F.sum("_v").alias("s")).collect())
    shift, before = [], 0
    for p, s in sums:
        shift.append((p, before))
        before += s
    offsets = df.sparkSession.createDataFrame(shift or [(0, 0)], "_p2 int, _before long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p2"))
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_part", "_p2", "_before")
