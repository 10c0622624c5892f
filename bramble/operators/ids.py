"""Node numbers in name order, translation, and the dictionary.

With nodes numbered in the byte order of their names, the names that begin with a
prefix are an interval of numbers. Equal names are ordered by the node's id as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.functions.names import all_prefixes
from bramble.operators.numbering import numbered


def by_name(attrs: DataFrame) -> DataFrame:
    """attrs(uid, name) -> uid, name, sid."""
    return numbered(attrs.select("uid", "name"), "sid", F.col("name"), F.col("uid").cast("string"))


def ranking(nodes: DataFrame, seed: str = "") -> DataFrame:
    """nodes(uid) -> uid, score: a permutation of 0..n-1 in the order of a hash."""
    return numbered(nodes.select("uid"), "score", F.md5(F.concat(F.lit(seed), F.col("uid").cast("string"))), F.col("uid"))


def compact(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> uid, id: the nodes that occur, numbered in the order of their ids."""
    nodes = edges.select(F.col("src").alias("uid")).union(edges.select("dst")).distinct()
    return numbered(nodes, "id", F.col("uid"))


def translate(df: DataFrame, mapping: DataFrame, columns: list[str], key: str = "uid", to: str = "sid") -> DataFrame:
    """Replace ids in the columns through the mapping; rows with an id that it lacks are dropped."""
    out = df
    for c in columns:
        out = out.join(mapping.select(F.col(key).alias("_key"), F.col(to).alias("_to")), F.col(c) == F.col("_key")).drop("_key", c).withColumnRenamed("_to", c)
    return out.select(*df.columns)


def untranslated(df: DataFrame, mapping: DataFrame, columns: list[str], key: str = "uid") -> DataFrame:
    """column and errors: how many rows hold an id that the mapping lacks."""
    parts = [df.join(mapping.select(F.col(key).alias("_key")), F.col(c) == F.col("_key"), "left_anti").agg(F.lit(c).alias("column_name"), F.count("*").alias("errors")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def prefix_range(ids: DataFrame, prefix: str) -> DataFrame:
    """One row l, r: the names that begin with the prefix have numbers in [l, r); -1, -1 if there are none. An empty prefix spans all."""
    found = ids.where(F.startswith("name", F.lit(prefix))).agg(F.min("sid").alias("l"), F.max("sid").alias("m"))
    return found.select(F.coalesce("l", F.lit(-1)).cast("long").alias("l"), F.coalesce(F.col("m") + 1, F.lit(-1)).cast("long").alias("r"))


def prefix_ranges(ids: DataFrame, longest: int) -> DataFrame:
    """prefix, l, r of every prefix of up to `longest` characters that occurs."""
    each = ids.select("sid", F.explode(all_prefixes(F.col("name"), longest)).alias("prefix"))
    return each.groupBy("prefix").agg(F.min("sid").alias("l"), (F.max("sid") + 1).alias("r"))


def rank(ids: DataFrame, name: str) -> DataFrame:
    """One row `rank`: the first number of exactly this name, or -1."""
    return ids.where(F.col("name") == name).agg(F.coalesce(F.min("sid"), F.lit(-1)).cast("long").alias("rank"))


def select(ids: DataFrame, number: int | Column) -> DataFrame:
    """The name of a number."""
    return ids.where(F.col("sid") == number).select("sid", "name")
