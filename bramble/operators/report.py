"""Reports over result rows (scheme, iteration, user_id, query, results, prefix_ns, inter_ns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(results: DataFrame, skip: int = 1, query_len: int | None = None) -> DataFrame:
    """Rows from iteration `skip` on, of queries of one length if given."""
    out = results.where(F.col("iteration") >= skip)
    return out if query_len is None else out.where(F.length("query") == query_len)


def timing(results: DataFrame, by: str = "scheme") -> DataFrame:
    """Of each group the mean and population variance, over (user, query), of their mean microseconds."""
    inner = results.groupBy(by, "user_id", "query").agg(F.avg(F.col("inter_ns") / 1000).alias("inter"), F.avg(F.col("prefix_ns") / 1000).alias("prefix"))
    return inner.groupBy(by).agg(F.count("*").alias("n"), F.avg("prefix").alias("prefix_us"), F.var_pop("prefix").alias("prefix_var"), F.avg("inter").alias("inter_us"), F.var_pop("inter").alias("inter_var"))


def by_length(results: DataFrame, by: str = "scheme", lengths=(1, 2, 3, 4, 5)) -> DataFrame:
    """One row a group with its mean microseconds for each query length."""
    inner = results.groupBy(by, F.length("query").alias("len"), "user_id", "query").agg(F.avg(F.col("inter_ns") / 1000).alias("us"))
    return inner.groupBy(by).pivot("len", list(lengths)).agg(F.avg("us")).select(by, *(F.col(str(n)).alias(f"len{n}") for n in lengths))
