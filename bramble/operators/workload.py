"""Query workloads: prefix frequencies, sampled users and queries, missing names.

Random choices are hash orders, so that they repeat and agree between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bramble.functions.names import prefix_of
from bramble.operators.numbering import checkpoint, numbered, running_sum


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    text = F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def prefix_cdf(names: DataFrame, length: int) -> DataFrame:
    """prefix, n, and the share of names up to it in byte order."""
    counts = checkpoint(names.groupBy(prefix_of(F.col("name"), length).alias("prefix")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return running_sum(counts, "before", F.col("n"), F.col("prefix")).select("prefix", "n", ((F.col("before") + F.col("n")) / total).alias("cdf"))


def user_buckets(degrees: DataFrame, buckets: int) -> DataFrame:
    """uid, deg, bucket: users by degree, then id, are dealt into buckets; each closes as soon as its own mass is at least 1/buckets of all edges.

    Users of one degree stand together, so the ends follow from the degree histogram,
    which has at most sqrt(2 * edges) rows and is all that is gathered. Users left over
    after the last bucket are dropped.
    """
    histogram = sorted((r.deg, r.n) for r in degrees.groupBy("deg").agg(F.count("*").alias("n")).collect())
    total, ends, at = sum(d * n for d, n in histogram), [], 0
    runs, left, k = histogram, (histogram[0][1] if histogram else 0), 0
    for _ in range(buckets):
        mass = 0
        while k < len(runs) and buckets * mass < total:
            deg = runs[k][0]
            take = left if deg == 0 else min(left, -(-(total - buckets * mass) // (buckets * deg)))
            mass, at, left = mass + take * deg, at + take, left - take
            if not left:
                k += 1
                left = runs[k][1] if k < len(runs) else 0
        ends.append(at)
    placed = numbered(degrees.select("uid", "deg"), "_place", F.col("deg"), F.col("uid"))
    bucket = F.lit(None).cast("int")
    for b in range(buckets - 1, -1, -1):
        bucket = F.when(F.col("_place") < ends[b], b).otherwise(bucket)
    return placed.withColumn("bucket", bucket).where("bucket is not null").select("uid", "deg", "bucket")


def bucket_stats(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("bucket").agg(F.min("deg").alias("min_deg"), F.max("deg").alias("max_deg"), F.count("*").alias("users"))


def users_by_bucket(dealt: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k users of each bucket, or all if it has fewer."""
    w = Window.partitionBy("bucket").orderBy(uniform(F.lit(seed), "uid"), "uid")
    return dealt.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def users_by_degree(degrees: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k users without replacement, with chances in proportion to degree: the smallest of -ln(u) / degree."""
    key = -F.log(uniform(F.lit(seed), "uid") + F.lit(1e-10)) / F.col("deg")
    return degrees.where("deg > 0").withColumn("_key", key).orderBy("_key", "uid").limit(k).drop("_key")


def _prefix_counts(pairs: DataFrame, ids: DataFrame, shortest: int, longest: int) -> DataFrame:
    """u, length, prefix and truth_count, the number of names that u reaches by it."""
    named = pairs.join(ids.select(F.col("sid").alias("dst"), "name"), "dst")
    cut = named.select(F.col("src").alias("u"), F.explode(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.struct(n.alias("length"), F.substring("name", F.lit(1), n).alias("prefix")))).alias("p"))
    return cut.groupBy("u", "p.length", "p.prefix").agg(F.count("*").alias("truth_count"))


def sample_queries(pairs: DataFrame, ids: DataFrame, shortest: int = 1, longest: int = 5, each: int = 1, seed: int = 42) -> DataFrame:
    """u, length, prefix, truth_count: for each user and length, `each` different prefixes of names it reaches, with chances in proportion to how many names have them.

    pairs(src, dst) are the users' reachable nodes. A user's names count by prefix
    first, so only counts meet. Drawing the smallest of -ln(u) / count without
    replacement equals drawing from the cumulative frequencies and skipping what was drawn.
    """
    counted = _prefix_counts(pairs, ids, shortest, longest)
    key = -F.log(uniform(F.lit(seed), "u", "length", "prefix") + F.lit(1e-10)) / F.col("truth_count")
    w = Window.partitionBy("u", "length").orderBy(key, "prefix")
    return counted.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= each).select("u", F.col("length").cast("long").alias("length"), "prefix", "truth_count")


def sample_repeated(pairs: DataFrame, ids: DataFrame, shortest: int = 1, longest: int = 5, each: int = 1, seed: int = 42) -> DataFrame:
    """u, length, draw, prefix: `each` independent draws for each user and length, so that a prefix may come again.

    A draw's number in [0, 1) falls into one prefix's part of the cumulative counts.
    """
    counted = _prefix_counts(pairs, ids, shortest, longest)
    mine = Window.partitionBy("u", "length")
    upto = F.sum("truth_count").over(mine.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto).withColumn("total", F.sum("truth_count").over(mine))
    spot = lambda d: uniform(F.lit(seed), "u", "length", d) * F.col("total")
    draws = F.filter(F.sequence(F.lit(0), F.lit(each - 1)), lambda d: (spot(d) >= F.col("upto") - F.col("truth_count")) & (spot(d) < F.col("upto")))
    return placed.withColumn("draw", F.explode(draws)).select("u", F.col("length").cast("long").alias("length"), "draw", "prefix")


def truth_of(sampled: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """sampled(u, prefix, ...) -> also truth, the sorted uids of the nodes that u reaches by the prefix."""
    named = pairs.join(ids.select(F.col("sid").alias("dst"), "name", "uid"), "dst").select(F.col("src").alias("u"), "name", "uid")
    hits = sampled.join(named, "u").where(F.startswith("name", F.col("prefix")))
    return hits.groupBy(*sampled.columns).agg(F.array_sort(F.collect_list("uid")).alias("truth"))


def power_law_graph(spark: SparkSession, nodes: int, links: int, seed: int = 42) -> DataFrame:
    """src, dst in both directions: each node links to `links` nodes before it, low numbers more often, so that degrees fall off as a power."""
    node = spark.range(1, nodes).select("id", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("k"))
    u = uniform(F.lit(seed), "id", "k")
    one = node.select(F.col("id").alias("src"), F.floor(F.col("id") * u * u).cast("long").alias("dst"))
    return one.union(one.select("dst", "src")).distinct()


def shuffled(queries: DataFrame, seed: int = 42) -> DataFrame:
    """The queries with their place in a hash order."""
    return numbered(queries, "place", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("qid").cast("string"))), F.col("qid"))


def fill_missing(nodes: DataFrame, attrs: DataFrame, seed: int = 42) -> DataFrame:
    """id, name, filled: nodes without a name get existing names of nodes, hash-shuffled, in turn by id."""
    known = nodes.join(attrs.select(F.col("uid").alias("id"), "name"), "id", "left").withColumn("filled", F.col("name").isNull() | (F.col("name") == ""))
    known = checkpoint(known)
    donors = numbered(known.where("not filled").select(F.col("id").alias("_donor"), F.col("name").alias("_name")), "_place", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("_donor").cast("string"))), F.col("_donor"))
    n = donors.count()
    if not n:
        return known
    wanting = numbered(known.where("filled").select("id"), "_turn", F.col("id")).withColumn("_place", F.col("_turn") % n)
    given = wanting.join(donors, "_place").select("id", F.col("_name").alias("name"), F.lit(True).alias("filled"))
    return known.where("not filled").select("id", "name", "filled").union(given)


def truth_by_number(queries: DataFrame, ids: DataFrame, k: int | None = None) -> DataFrame:
    """queries(qid, truth) with truth's user ids as sorted node numbers, or as the k best-scored; ids that have no node are dropped."""
    each = queries.select("qid", F.explode("truth").alias("uid")).join(ids.select("uid", "sid", "score"), "uid")
    best = F.sort_array(F.collect_list(F.struct("score", "sid")), asc=False)
    if k is not None:
        found = each.groupBy("qid").agg(F.transform(F.slice(best, 1, k), lambda x: x["sid"]).alias("truth"))
    else:
        found = each.groupBy("qid").agg(F.array_sort(F.collect_list("sid")).alias("truth"))
    return queries.drop("truth").join(found, "qid", "left").withColumn("truth", F.coalesce("truth", F.array().cast("array<bigint>")))


def attribute_cdf(counts: DataFrame, cumulative: bool = True) -> DataFrame:
    """counts(attribute, n) in the order of n, then attribute: each one's share, or the share up to it."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    if not cumulative:
        return counts.select("attribute", "n", (F.col("n") / total).alias("share"))
    return running_sum(counts, "before", F.col("n"), F.col("n"), F.col("attribute")).select("attribute", "n", ((F.col("before") + F.col("n")) / total).alias("share"))
