"""Mixing sources to target weights.

A document's size is its number of words. Sources by code point, null last, weigh
3, 1, 2 and so on; together they share 1.5 times all sizes in proportion to weight.
No source takes more than twice its size: what is above is shared out anew by weight
among the others until none is above. That fixed point is min(2 * size, level *
weight), whose level follows from prefix sums over the sources by size/weight, so no
loop is needed.

Each document has a hash-random key of 60 bits, from the MD5 of a seed, its doc_id and
its text's MD5. Within a source, documents are range-partitioned
by key into buckets of about `bucket` rows, each bucket is sorted and summed by
itself, and a second, small prefix sum over the buckets gives each its offset: no
source ever lies in one task. The budget is the target rounded down; whole epochs
repeat every document, and the last epoch is cut at exactly the budget's word, inside
a document if need be.

Equal rows count as one row of so many copies, and only in the end become rows again,
a bounded number from each, so that they crowd no bucket. Sources are numbered and
summed by ranges too; however many there are, one row each reaches no single task.

Null texts count as empty, and texts of any length are counted whole. Documents of
size zero take nothing, and sources of size zero have target zero. Of equal rows, those
that the budget ends among are told apart by position only, so the rows come out the
same. Other columns are ignored, or carried by the mix itself. An empty input gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bramble.llm.common import WORD, checkpoint, content_keyed, prefix_sums, text_of

WEIGHTS, SHARE, MOST_EPOCHS, BUCKET = (3, 1, 2), 1.5, 2, 4096
#: Copies that one row becomes.
COPIES = 4096


def words_of(text: Column) -> Column:
    """The number of words, from the spaces between them: no array of words is built."""
    bare = F.regexp_replace(text, WORD, "w")
    return (F.length(bare) - F.length(F.translate(bare, "w", ""))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> also weight and target."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = prefix_sums(sources, {"_place": F.lit(1)}, "long", *order)
    weighed = placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int")))
    full = weighed.withColumn("cap", epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = checkpoint(prefix_sums(full, {"_caps": F.col("cap"), "_weights": F.col("weight")}, "double", F.col("ratio"), *order))
    size, weight = rows.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    level = (F.lit((size or 0.0) * share) - F.col("_caps")) / (F.lit(weight or 1.0) - F.col("_weights"))
    # of equal ratios the first: once one of them is taken out, the level falls
    first = rows.select("ratio", (-level).alias("less")).where("-less < ratio").agg(F.min(F.struct("ratio", "less")).alias("f")).first().f
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(-first.less) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(rows: DataFrame, key: Column, seed: int = 0, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, bucket: int = BUCKET) -> DataFrame:
    """rows(source, size, ...) -> each distinct row with copies, source_size, target, turns (whole epochs) and rest, what the copies together take of the last epoch; key, a string, tells rows apart and is hashed with the seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    keyed = rows.withColumn("_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    rows = checkpoint(keyed.groupBy(*keyed.columns).agg(F.count("*").alias("copies")))
    sources = checkpoint(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("_rows")))
    planned = targets(sources.select("source", "source_size"), weights, share, epochs)
    planned = checkpoint(planned.join(sources.select(F.col("source").alias("s2"), "_rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    # buckets of a source are equal ranges of its keys
    plan = planned.select(F.col("source").alias("s2"), "source_size", "target", F.ceil(F.col("_rows") / bucket).alias("_n"))
    spread = (F.col("_key") / F.lit(2.0**60)) * F.col("_n")
    with_plan = rows.join(F.broadcast(plan) if _small(planned) else plan, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    placed = with_plan.withColumn("_bucket", F.least(F.floor(spread), F.col("_n") - 1).cast("long")).drop("_n")
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("source", "_bucket").agg(F.sum(words).alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s2"), F.col("_bucket").alias("b2"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("_bucket") == F.col("b2"))).drop("s2", "b2")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    before = F.col("_offset") + F.coalesce(F.sum(words).over(within), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(words, F.floor("target").cast("long") - turns * F.col("source_size") - before)).cast("long")
    return placed.withColumn("turns", turns).withColumn("rest", rest).drop("_bucket", "_offset")


def _small(planned: DataFrame, most: int = 10_000) -> bool:
    """Whether the plan of the sources is small enough to broadcast."""
    return planned.limit(most + 1).count() <= most


def _parts(rows: DataFrame, n: Column, copies: int) -> DataFrame:
    """Each row with `_part` from 0, a part for every `copies` of n; where any row has several, they are dealt out."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / copies))))
    return parts if rows.where(n > copies).isEmpty() else parts.repartition("_key", "_part")


def mixture(docs: DataFrame, copies: int = COPIES, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(text_of()).alias("size"), F.md5(text_of()).alias("_tie"))
    blocks = checkpoint(mix(rows, F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_tie"), **how))
    first = F.col("_part") * copies
    each = _parts(blocks, F.col("copies"), copies).withColumn("_copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + copies) - 1)))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_copy") * F.col("size")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("turns") * F.col("size") + rest).cast("long").alias("taken"))


def apply_mixture(docs: DataFrame, copies: int = COPIES, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and the one that the budget ends in cut after the last word taken. All columns as they were."""
    keyed = content_keyed(docs)
    rows = keyed.select("h1", "h2", F.col("row.source").cast("string").alias("source"), words_of(F.col("text")).alias("size"))
    blocks = mix(rows, F.concat_ws("|", F.col("h1").cast("string"), F.col("h2").cast("string")), **how)
    # equal rows share what they take: one of them stands for all
    words = F.col("turns") * F.col("size") * F.col("copies") + F.col("rest")
    taken = checkpoint(blocks.select("h1", "h2", "_key", "size", words.alias("words")).where("words > 0"))
    once = keyed.select("h1", "h2", "row").dropDuplicates(["h1", "h2"])
    parts = _parts(taken, F.expr("(words + size - 1) div size"), copies)
    left = F.col("words") - F.col("_part") * copies * F.col("size")
    parts = parts.select("h1", "h2", "size", F.least(left, F.col("size") * copies).alias("words"))
    part = F.expr("words % size")
    counts = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.expr("words div size").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = once.join(parts, ["h1", "h2"]).select("row", F.explode(counts).alias("words"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(first_words(text_of("row.text"), F.col("words")))
    return each.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), n.cast("int")).alias("gap"), F.slice(words, F.lit(1), n.cast("int")).alias("word"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], p["word"])), "")
