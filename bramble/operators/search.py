"""Friend and friend-of-friend search by prefix, for batches of queries.

Queries are rows (qid, u, prefix). Each prefix is looked up once as an interval of
node numbers; the interval then filters inside the equi-joins on node numbers, so no
theta join is planned. All strategies of one logical query return the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.functions.names import all_prefixes, prefix_of
from bramble.operators.ids import prefix_ranges


def with_ranges(queries: DataFrame, ids: DataFrame, longest: int) -> DataFrame:
    """The queries that match any name, with their interval [l, r). An empty prefix spans all."""
    whole = ids.agg(F.lit("").alias("prefix"), F.min("sid").alias("l"), (F.max("sid") + 1).alias("r"))
    return queries.join(prefix_ranges(ids, longest).union(whole), "prefix")


def hops(queries: DataFrame, graph: DataFrame) -> DataFrame:
    """The queries with `via`: the user and each friend."""
    own = queries.withColumn("via", F.col("u"))
    return own.union(queries.join(graph.select(F.col("src").alias("u"), F.col("dst").alias("via")), "u").select(*own.columns))


def _reached(hop: DataFrame, graph: DataFrame) -> DataFrame:
    return hop.join(graph.select(F.col("src").alias("via"), F.col("dst").alias("v")), "via")


def friend(ranged: DataFrame, graph: DataFrame) -> DataFrame:
    """qid, u, v: friends within the interval. A user's edge to itself counts, as do repeats."""
    near = ranged.join(graph.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    return near.where("v >= l and v < r").select("qid", "u", "v")


def fof(ranged: DataFrame, graph: DataFrame) -> DataFrame:
    """qid, u, v: distinct friends and friends of friends within the interval, without the user."""
    return _reached(hops(ranged, graph), graph).where("v >= l and v < r and v <> u").select("qid", "u", "v").distinct()


def fof_materialised(ranged: DataFrame, two_steps: DataFrame) -> DataFrame:
    """The same over a graph that already holds all pairs within two steps."""
    return friend(ranged, two_steps)


# Baselines work on a graph numbered by node id, where a prefix is a set, not an interval.


def candidates(ids: DataFrame, remap: DataFrame, longest: int) -> DataFrame:
    """prefix, id: the nodes whose names begin with the prefix. remap(uid, id)."""
    return ids.join(remap, "uid").select(F.explode(all_prefixes(F.col("name"), longest)).alias("prefix"), "id")


def friend_baseline(queries: DataFrame, graph: DataFrame, named: DataFrame) -> DataFrame:
    """Friends that are among the prefix's candidates, by a semi join."""
    near = queries.join(graph.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    return near.join(named.select("prefix", F.col("id").alias("v")), ["prefix", "v"], "left_semi").select("qid", "u", "v")


def fof_baseline(queries: DataFrame, graph: DataFrame, named: DataFrame) -> DataFrame:
    near = _reached(hops(queries, graph), graph).where("v <> u").select("qid", "u", "prefix", "v").distinct()
    return near.join(named.select("prefix", F.col("id").alias("v")), ["prefix", "v"], "left_semi").select("qid", "u", "v")


def friend_fast_baseline(ranged: DataFrame, graph: DataFrame, rank: DataFrame) -> DataFrame:
    """Friends whose place in name order lies in the interval. rank(id, sid)."""
    near = ranged.join(graph.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    return near.join(rank.select(F.col("id").alias("v"), "sid"), "v").where("sid >= l and sid < r").select("qid", "u", "v")


def fof_fast_baseline(ranged: DataFrame, graph: DataFrame, rank: DataFrame) -> DataFrame:
    placed = graph.join(rank.select(F.col("id").alias("dst"), "sid"), "dst")
    near = hops(ranged, graph).join(placed.select(F.col("src").alias("via"), F.col("dst").alias("v"), "sid"), "via")
    return near.where("sid >= l and sid < r and v <> u").select("qid", "u", "v").distinct()


def counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """qid and the number of hits, 0 for queries without any."""
    found = hits.groupBy("qid").agg(F.count("*").alias("results"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("results", F.lit(0)).alias("results"))


def truth(queries: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits found from the names themselves, to check the intervals with. pairs(src, dst)."""
    near = queries.join(pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    named = near.join(ids.select(F.col("sid").alias("v"), "name"), "v")
    return named.where(prefix_of(F.col("name"), F.length("prefix")) == F.col("prefix")).select("qid", "u", "v")


SCHEMES = {
    "asindex": "friend", "baseline-asindex": "friend", "fast-baseline-asindex": "friend",
    "hopping": "fof", "baseline-hopping": "fof", "fast-baseline-hopping": "fof",
    "topk-hopping": "topk", "topk-hopping-wand": "topk", "topk-hopping-rmq": "topk", "topk-hopping-rmq-wand": "topk",
}
