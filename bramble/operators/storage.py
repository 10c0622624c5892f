"""Stored indexes: writing, opening, verifying, codes and sizes.

An index is Parquet sorted by (src, dst) in ranges, so that a source's list is a run
of rows and an interval filter skips pages by their statistics. Posting codecs
are storage formats only and don't change answers; sizes are modelled by formulas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from bramble.functions.postings import elias_fano_bits, fixed_bytes, interpolative_bits, optpfor_bits, single_bits, varint_bytes
from bramble.operators.graph import out_degree, universe, wand_bound
from bramble.operators.numbering import running_sum


@dataclass
class Index:
    postings: DataFrame
    nodes: DataFrame


def write_index(edges: DataFrame, path: str, scores: DataFrame | None = None) -> None:
    """Postings and nodes(src, degree[, bound]) below path; with scores(sid, score), postings carry dst's score."""
    rows, nodes = edges.select("src", "dst"), out_degree(edges).withColumnRenamed("deg", "degree")
    if scores is not None:
        rows = rows.join(scores.select(F.col("sid").alias("dst"), "score"), "dst").select("src", "dst", "score")
        nodes = nodes.join(wand_bound(edges, scores), "src")
    rows.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/nodes"))


def verify(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: edges of either side that the other lacks, repeats counted."""
    tagged = edges.select("src", "dst", F.lit(1).alias("a"), F.lit(0).alias("b")).union(stored.select("src", "dst", F.lit(0), F.lit(1)))
    diff = tagged.groupBy("src", "dst").agg((F.sum("a") - F.sum("b")).alias("d"))
    return diff.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("unexpected"))


def _list() -> WindowSpec:
    return Window.partitionBy("src").orderBy("dst")


def gap_encode(edges: DataFrame) -> DataFrame:
    """src, position, gap: each id less the one before less one."""
    return edges.select("src", (F.row_number().over(_list()) - 1).cast("long").alias("position"), (F.col("dst") - F.coalesce(F.lag("dst").over(_list()), F.lit(-1)) - 1).alias("gap"))


def gap_decode(code: DataFrame) -> DataFrame:
    """src, dst from src, position, gap."""
    upto = Window.partitionBy("src").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return code.select("src", (F.sum("gap").over(upto) + F.col("position")).alias("dst"))


def block_max(edges: DataFrame, size: int = 128) -> DataFrame:
    """src, block, largest: of each block of `size` postings the largest id."""
    placed = edges.select("src", "dst", F.floor((F.row_number().over(_list()) - 1) / size).cast("long").alias("block"))
    return placed.groupBy("src", "block").agg(F.max("dst").alias("largest"))


def elias_fano_size(edges: DataFrame) -> DataFrame:
    """src, n, bits of each list by the Elias-Fano formula over the graph's universe."""
    return out_degree(edges).select("src", F.col("deg").alias("n"), elias_fano_bits(F.col("deg"), _universe(edges)).alias("bits"))


def _universe(edges: DataFrame) -> Column:
    return F.lit(universe(edges).first()[0] or 0).cast("long")


def varint_size(edges: DataFrame) -> DataFrame:
    """src, n, bytes of each list's gaps at seven bits a byte."""
    return gap_encode(edges).groupBy("src").agg(F.count("*").alias("n"), F.sum(varint_bytes(F.col("gap"))).alias("bytes"))


def rmq_buckets(edges: DataFrame, hint: int = 1 << 20) -> DataFrame:
    """src, bucket, first: a node's score list belongs to the bucket of its place in all lists put together by node, in stretches of `hint` scores; first is the place where the bucket's scores begin."""
    degrees = running_sum(out_degree(edges), "before", F.col("deg"), F.col("src"))
    bucket = F.floor(F.col("before") / hint).cast("long")
    placed = degrees.select("src", "before", bucket.alias("bucket"))
    starts = placed.groupBy("bucket").agg(F.min("before").alias("first"))
    return placed.join(starts, "bucket").select("src", "bucket", "first")


def partition_sizes(edges: DataFrame, size: int = 128) -> DataFrame:
    """src, uniform, optpfor: estimated bits of each list in parts of `size` ids, each part in its best form over its own span or as a block of gaps with exceptions."""
    coded = gap_encode(edges).withColumn("block", F.floor(F.col("position") / size))
    over = [F.sum((F.col("gap") >= 1 << b).cast("long")).alias(f"o{b}") for b in range(33)]
    parts = coded.groupBy("src", "block").agg(F.count("*").alias("n"), (F.sum("gap") + F.count("*")).alias("span"), *over)
    # a part costs its form and 64 bits for its end and place
    bits = parts.select("src", (single_bits(F.col("n"), F.col("span")) + 64).alias("uniform"), optpfor_bits([F.col(f"o{b}") for b in range(33)], F.col("n")).alias("optpfor"))
    return bits.groupBy("src").agg(F.sum("uniform").alias("uniform"), F.sum("optpfor").alias("optpfor"))


def index_stats(edges: DataFrame) -> DataFrame:
    """One row a codec: lists, elements, estimated bits, and bits for each element and list.

    All sizes are models; `opt`, whose parts are chosen by dynamic programming, has none.
    """
    lists = gap_encode(edges).groupBy("src").agg(F.count("*").alias("n"), F.sum(varint_bytes(F.col("gap"))).alias("varint"), (F.sum("gap") + F.count("*")).alias("span"))
    lists = lists.join(partition_sizes(edges), "src")
    u = _universe(edges)
    bits = {
        "ef": elias_fano_bits(F.col("n"), u),
        "single": single_bits(F.col("n"), u),
        "uniform": F.col("uniform"),
        "block_optpfor": F.col("optpfor"),
        "block_varint": 8 * F.col("varint"),
        "block_interpolative": interpolative_bits(F.col("n"), F.col("span")),
        "fixed": 8 * fixed_bytes(F.col("n")),
    }
    sums = lists.agg(F.count("*").alias("docs"), F.sum("n").alias("elements"), *(F.sum(v).alias(k) for k, v in bits.items()))
    codecs = F.explode(F.array(*(F.struct(F.lit(k).alias("codec"), F.col(k).alias("bits")) for k in bits)))
    rows = sums.select("docs", "elements", codecs.alias("c"))
    return rows.select("c.codec", "docs", "elements", F.col("c.bits").alias("bits"), (F.col("elements") / F.col("docs")).alias("elements_per_doc"), (F.col("c.bits") / F.col("docs")).alias("bits_per_doc"), (F.col("c.bits") / F.col("elements")).alias("bits_per_element"))
