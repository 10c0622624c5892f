"""Search by the name of a strategy."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.operators import graph, ids, search, topk, workload
from bramble.operators.numbering import checkpoint
from bramble.operators.search import SCHEMES
from bramble.plans.built import Built


def run(b: Built, queries: DataFrame, scheme: str, k: int = 0, longest: int | None = None, threshold: int = 1000) -> DataFrame:
    """queries(qid, uid, prefix) -> qid, v (and rank, score for top-k schemes); v is a node's number in name order.

    Prefixes of over `longest` characters match nothing; without it, the queries' longest
    prefix counts. The scheme `coverage` was
    never defined and is refused, as are unknown names.
    """
    if scheme == "coverage":
        raise NotImplementedError("coverage")
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; known: {', '.join(SCHEMES)}")
    if (SCHEMES[scheme] == "topk") != (k > 0):
        raise ValueError("k > 0 is for top-k schemes, and they need it")
    if longest is None:
        longest = queries.agg(F.max(F.length("prefix"))).first()[0] or 0
    both = b.ids.join(b.remap, "uid", "left").select("uid", "sid", "id")
    asked = queries.select("qid", "uid", "prefix").join(both, "uid")
    if scheme in ("baseline-asindex", "fast-baseline-asindex", "baseline-hopping", "fast-baseline-hopping"):
        rows = asked.where("id is not null").select("qid", F.col("id").alias("u"), "prefix")
        if scheme.startswith("fast"):
            f = search.friend_fast_baseline if scheme.endswith("asindex") else search.fof_fast_baseline
            hits = f(search.with_ranges(rows, b.ids, longest), b.compact, both.where("id is not null").select("id", "sid"))
        else:
            f = search.friend_baseline if scheme.endswith("asindex") else search.fof_baseline
            named = search.candidates(b.ids, b.remap, longest)
            whole = b.remap.select(F.lit("").alias("prefix"), "id")
            hits = f(rows, b.compact, named.union(whole))
        return hits.join(both.select(F.col("id").alias("v"), "sid"), "v").select("qid", F.col("sid").alias("v"))
    ranged = search.with_ranges(asked.select("qid", F.col("sid").alias("u"), "prefix"), b.ids, longest)
    if scheme == "asindex":
        return search.friend(ranged, b.edges).select("qid", "v")
    if scheme == "hopping":
        return search.fof(ranged, b.edges).select("qid", "v")
    if scheme == "topk-hopping":
        return topk.hopping(ranged, b.edges, b.scored, k)
    if scheme == "topk-hopping-wand":
        return topk.wand(ranged, b.edges, b.scored, b.bounds, k)
    if scheme == "topk-hopping-rmq":
        return topk.rmq(ranged, b.edges, b.scored, k)
    return topk.rmq_wand(ranged, b.edges, b.scored, b.bounds, graph.out_degree(b.edges), k, threshold)


class WrongResults(AssertionError):
    """A search gave other results than the truth that its queries hold."""


def search_run(b: Built, queries: DataFrame, scheme: str, k: int = 0, iterations: int = 3, verification: bool = True) -> DataFrame:
    """queries(qid, uid, prefix[, truth]) run `iterations` times -> iteration, user_id, query, l, r, results, prefix_ns, inter_ns, as a result file has them.

    All queries of an iteration run as one batch, so a query's times are the batch's
    share of one: prefix_ns of looking up the intervals, inter_ns of the search. A prefix
    that no name has gives l = r = -1 and no results. With verification, results are held
    against truth, user ids in any order, of which top-k schemes expect the k best.
    """
    asked = checkpoint(queries.join(b.ids.select("uid"), "uid", "left_semi"))
    n, longest = asked.agg(F.count("*"), F.max(F.length("prefix"))).first()
    out = None
    for i in range(iterations):
        began = time.perf_counter_ns()
        ranges = ids.prefix_ranges(b.ids, longest or 0)
        whole = b.ids.agg(F.lit("").alias("prefix"), F.min("sid").alias("l"), (F.max("sid") + 1).alias("r"))
        placed = checkpoint(asked.join(ranges.union(whole), "prefix", "left").select("qid", "uid", "prefix", F.coalesce("l", F.lit(-1)).alias("l"), F.coalesce("r", F.lit(-1)).alias("r")))
        found = time.perf_counter_ns()
        hits = checkpoint(run(b, asked, scheme, k, longest or 0).select("qid", "v"))
        ended = time.perf_counter_ns()
        if verification and "truth" in asked.columns:
            verify(b, asked, hits, k)
        counted = search.counts(placed, hits).join(placed, "qid")
        ns = [F.lit(t // max(n, 1)).cast("long").alias(c) for t, c in ((found - began, "prefix_ns"), (ended - found, "inter_ns"))]
        rows = counted.select(F.lit(i).alias("iteration"), F.col("uid").alias("user_id"), F.col("prefix").alias("query"), F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "results", *ns)
        out = rows if out is None else out.union(rows)
    return out


def verify(b: Built, queries: DataFrame, hits: DataFrame, k: int = 0) -> None:
    """Raise WrongResults where hits(qid, v) are not the queries' truth; nodes are compared by their numbers."""
    truth = workload.truth_by_number(queries.select("qid", "truth"), b.ids, k or None).select("qid", F.explode("truth").alias("v"), F.lit(1).alias("d"))
    both = truth.union(hits.select("qid", "v", F.lit(-1)))
    wrong = both.groupBy("qid", "v").agg(F.sum("d").alias("d")).where("d <> 0").limit(5).collect()
    if wrong:
        raise WrongResults("; ".join(f"query {r.qid}: node {r.v} {'missing' if r.d > 0 else 'unexpected'}" for r in wrong))
