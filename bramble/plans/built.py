"""A graph built once a session: numbered nodes and renumbered edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.operators import graph, ids, workload
from bramble.operators.numbering import checkpoint
from bramble.sources import tables

#: Query lengths of a workload.
SHORTEST, LONGEST = 1, 5


@dataclass
class Built:
    """raw(src, dst) by uid; ids(uid, name, sid, score); edges(src, dst) by sid; remap(uid, id), compact(src, dst) by id."""

    raw: DataFrame
    ids: DataFrame
    edges: DataFrame
    remap: DataFrame
    compact: DataFrame

    # made once, when first asked for: what a top-k index stores besides

    @cached_property
    def scored(self) -> DataFrame:
        return checkpoint(self.edges.join(self.ids.select(F.col("sid").alias("dst"), "score"), "dst").select("src", "dst", "score"))

    @cached_property
    def two(self) -> DataFrame:
        return checkpoint(graph.expand(self.edges, 2))

    @cached_property
    def bounds(self) -> DataFrame:
        return checkpoint(self.scored.groupBy("src").agg(F.max("score").alias("bound")))


def build(attrs: DataFrame, raw: DataFrame) -> Built:
    raw = checkpoint(raw.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    attrs = attrs.select(F.col("uid").cast("long").alias("uid"), "name")
    named = checkpoint(ids.by_name(attrs).join(ids.ranking(attrs), "uid").select("uid", "name", "sid", "score"))
    remap = checkpoint(ids.compact(raw).select("uid", "id"))
    edges = checkpoint(ids.translate(raw, named, ["src", "dst"]))
    return Built(raw, named, edges, remap, checkpoint(ids.translate(raw, remap, ["src", "dst"], to="id")))


_SESSIONS: dict[tuple[str, str], Built] = {}
_WORKLOADS: dict[tuple[str, str], DataFrame] = {}


def built(spark: SparkSession, sf_dir: str) -> Built:
    """The index of a directory's tables; queries of one session share it, as they would a stored one."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SESSIONS:
        _SESSIONS[key] = build(tables.attributes(spark, sf_dir), tables.raw_edges(spark, sf_dir))
    return _SESSIONS[key]


def workload_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, u, prefix: for every user and length one prefix among the names within two steps."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WORKLOADS:
        b = built(spark, sf_dir)
        sampled = workload.sample_queries(b.two, b.ids, SHORTEST, LONGEST)
        _WORKLOADS[key] = checkpoint(sampled.select((F.col("u") * 10 + F.col("length")).alias("qid"), "u", "prefix"))
    return _WORKLOADS[key]
