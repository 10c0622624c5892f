"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session may do without: executors of a cluster don't see a folder of ours."""
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
    """Cut the lineage with a reliable copy in the session's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts at a time are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def content_keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), id, text, and 128 bits h1, h2 of the row's whole content; equal rows have equal keys."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the hash skips nulls, so a flag in front of each value tells where they stand
    said = [x for c in columns for x in (c.isNull(), c)]
    return docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"), text_of().alias("text"))


def prefix_sums(df: DataFrame, values: dict[str, Column], kind: str, *order: Column) -> DataFrame:
    """df with, for each name, the sum of its value over all rows before in the order, which should be total.

    Ranges are sorted and summed by themselves and shifted by the sums of the ranges
    before; only these, one row a partition, reach the driver.
    """
    rows = df.select("*", *(v.cast(kind).alias(f"_v_{k}") for k, v in values.items())).repartitionByRange(*order)
    rows = checkpoint(rows.withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(k) for k in values)).collect()
    before, shift = [0] * len(values), []
    for r in sorted(sums, key=lambda r: r["_part"]):
        shift.append((r["_part"], *before))
        before = [b + r[k] for b, k in zip(before, values, strict=True)]
    put = float if kind == "double" else int
    offsets = df.sparkSession.createDataFrame([(p, *map(put, x)) for p, *x in shift] or [(0, *[put(0)] * len(values))], "_p2 int, " + ", ".join(f"_o_{k} {kind}" for k in values))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p2"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0).cast(kind))).alias(k) for k in values))
