"""The k friends of friends with the highest static score, by four strategies.

Ties in score go to the larger node. Every strategy drops repeats and the user before
it cuts, so all return the same rows. Hops are rows (qid, u, l, r, via).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.operators.search import hops


def _best(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("v"))


def cut(hits: DataFrame, k: int) -> DataFrame:
    """qid, rank, v, score: the k best of distinct hits(qid, v, score)."""
    ranked = hits.select("qid", "v", "score").distinct().withColumn("rank", F.row_number().over(_best("qid")))
    return ranked.where(F.col("rank") <= k).select("qid", F.col("rank").cast("long").alias("rank"), "v", "score")


def _hits(hop: DataFrame, scored: DataFrame) -> DataFrame:
    """scored(src, dst, score)."""
    near = hop.join(scored.select(F.col("src").alias("via"), F.col("dst").alias("v"), "score"), "via")
    return near.where("v >= l and v < r and v <> u")


def hopping(ranged: DataFrame, graph: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    return cut(_hits(hops(ranged, graph), scored), k)


def wand(ranged: DataFrame, graph: DataFrame, scored: DataFrame, bounds: DataFrame, k: int, first: int = 4) -> DataFrame:
    """Two phases: the friends with the highest bounds give a threshold, the k-th score among their hits; of the others only lists whose bound reaches it are read.

    A list whose best score is below the threshold can't change the answer. With fewer
    than k hits the threshold is -1 and nothing is left out. bounds(src, bound).
    """
    return cut(_wand_hits(hops(ranged, graph), scored, bounds, k, first), k)


def _wand_hits(hop: DataFrame, scored: DataFrame, bounds: DataFrame, k: int, first: int) -> DataFrame:
    bounded = hop.join(bounds.select(F.col("src").alias("via"), "bound"), "via")
    placed = bounded.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "via")))
    early = _hits(placed.where(F.col("place") <= first), scored).select("qid", "v", "score")
    limits = cut(early, k).where(F.col("rank") == k).select("qid", F.col("score").alias("limit"))
    late = placed.where(F.col("place") > first).join(limits, "qid", "left").where(F.col("bound") >= F.coalesce("limit", F.lit(-1)))
    return early.union(_hits(late, scored).select("qid", "v", "score"))


def rmq(ranged: DataFrame, graph: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Of each friend's list only the k best within the interval go on."""
    return cut(_rmq_hits(hops(ranged, graph), scored, k), k)


def _rmq_hits(hop: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    near = _hits(hop, scored).withColumn("place", F.row_number().over(_best("qid", "via")))
    return near.where(F.col("place") <= k).select("qid", "v", "score")


def rmq_wand(ranged: DataFrame, graph: DataFrame, scored: DataFrame, bounds: DataFrame, degrees: DataFrame, k: int, threshold: int = 1000, first: int = 4) -> DataFrame:
    """Long lists by rmq, the others by wand. degrees(src, deg)."""
    sized = hops(ranged, graph).join(degrees.select(F.col("src").alias("via"), "deg"), "via")
    long = _rmq_hits(sized.where(F.col("deg") >= threshold), scored, k)
    return cut(long.union(_wand_hits(sized.where(F.col("deg") < threshold), scored, bounds, k, first)), k)


def stream(ranged: DataFrame, scored: DataFrame) -> DataFrame:
    """qid, place, v, score: the user's own list within the interval, best first; equal scores by the smaller node."""
    near = ranged.join(scored.select(F.col("src").alias("u"), F.col("dst").alias("v"), "score"), "u").where("v >= l and v < r")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "v")
    return near.select("qid", F.row_number().over(w).cast("long").alias("place"), "v", "score")
