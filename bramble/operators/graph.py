"""Graphs as edge rows (src, dst): degrees, neighbours, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.operators.numbering import running_sum


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def sources_only(rows: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """The rows whose column is a source of the graph."""
    return rows.join(edges.select(F.col("src").alias(column)).distinct(), column, "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its sorted neighbours as one array: for nodes whose lists fit a row."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("deg"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return out_degree(edges).groupBy("deg").agg(F.count("*").alias("n"))


def universe(edges: DataFrame) -> DataFrame:
    """The largest id of either column, and one."""
    return edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).cast("long").alias("universe"))


def wand_bound(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """src and the largest score among its neighbours. scores(sid, score)."""
    return edges.join(scores.select(F.col("sid").alias("dst"), "score"), "dst").groupBy("src").agg(F.max("score").alias("bound"))


def cumulative_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """sid, degree, and the sum of degree + 1 over all nodes before."""
    every = nodes.select("sid").join(out_degree(edges).withColumnRenamed("src", "sid"), "sid", "left").select("sid", F.coalesce("deg", F.lit(0)).alias("degree"))
    return running_sum(every, "cdf_degree", F.col("degree") + 1, F.col("sid"))


def expand(edges: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst): the nodes within k steps of each source (all of the graph's, or the given ones).

    For one step, a node's edge to itself stays; for more, the source is left out. Each
    level joins only the pairs that the level before found new.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    start = edges if sources is None else edges.join(sources.select("src"), "src", "left_semi")
    if k == 1:
        return start
    found = front = start.distinct()
    for level in range(2, k + 1):
        step = front.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        if level < k:
            step = step.join(found, ["src", "dst"], "left_anti")
        found, front = found.union(step), step
    return found.where("src <> dst").distinct()


def expansion_sizes(edges: DataFrame, k: int) -> DataFrame:
    """src and the number of nodes within k steps, 0 for sources that reach only themselves."""
    sizes = expand(edges, k).groupBy("src").agg(F.count("*").alias("n"))
    return edges.select("src").distinct().join(sizes, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))


def dataset_stats(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One row: nodes, edges, pairs within two steps, mean degrees, characters of names."""
    zero = F.lit(0).cast("long")
    parts = [
        names.agg(F.count("*"), F.sum(F.length("name")), zero, zero, zero),
        out_degree(edges).agg(zero, zero, F.sum("deg"), F.count("*"), zero),
        expansion_sizes(edges, 2).agg(zero, zero, zero, zero, F.sum("n")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).toDF("vertices", "name_chars", "edges1", "sources", "edges2")
    sums = rows.agg(*(F.sum(c).alias(c) for c in rows.columns))
    return sums.select("vertices", "name_chars", "edges1", "edges2", (F.col("edges1") / F.col("sources")).alias("avg_deg1"), (F.col("edges2") / F.col("sources")).alias("avg_deg2"))


def drop_repeats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key's values in order, those that differ from the one before."""
    w = Window.partitionBy(key).orderBy(value)
    return rows.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")
