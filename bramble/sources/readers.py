"""Text sources. Compression (.gz, .bz2) follows from the extension.

A compressed text file is read by one task; rewrite large ones to Parquet once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.functions.names import is_ascii, lower_ascii


def tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated src, dst."""
    return tsv(spark, path, "src long, dst long")


def edges_by_source(spark: SparkSession, path: str) -> DataFrame:
    """The same, grouped: src and its neighbours in order."""
    return edges(spark, path).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated uid, name."""
    return tsv(spark, path, "uid long, name string")


def vector(spark: SparkSession, path: str) -> DataFrame:
    """value and its line number from 0, of a file with one number a line; one file, hence one numbering."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("_at"))
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r["n"]) for r in lines.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    shift, before = [], 0
    for p, n in counts:
        shift.append((p, before))
        before += n
    offsets = spark.createDataFrame(shift or [(0, 0)], "_p long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return lines.join(F.broadcast(offsets), part == F.col("_p")).select(place.alias("line"), F.col("value").cast("long").alias("value"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """id and value of tab-separated pairs; of an id's several lines the last counts."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.split("value", "\t").alias("p"))
    return rows.groupBy(F.get("p", F.lit(0)).cast("long").alias("id")).agg(F.max_by(F.get("p", F.lit(1)).cast("long"), "_at").alias("value"))


def id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """uid and sid of a file with one id a line in name order."""
    return vector(spark, path).select(F.col("value").alias("uid"), F.col("line").alias("sid"))


def results(spark: SparkSession, paths: str) -> DataFrame:
    """Result files, comma-separated paths."""
    return tsv(spark, paths.split(","), "iteration int, user_id long, query string, l int, r int, results long, prefix_ns long, inter_ns long").fillna("", "query")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of qid, uid, prefix and, with verification, truth."""
    return spark.read.schema("qid long, uid long, prefix string, truth array<bigint>").json(path)


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """uid, prefix, truth of query files in lines: a flag, a user, the number of queries; then of each query its prefix and, if the flag is 1, the number of results and the results. Each file is parsed by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                lines, out = iter(text.split("\n")), []
                for flag in lines:
                    if not flag.strip():
                        continue
                    uid, n = int(next(lines)), int(next(lines))
                    for _ in range(n):
                        prefix = next(lines)
                        out.append({"uid": uid, "prefix": prefix, "truth": [int(next(lines)) for _ in range(int(next(lines)))] if flag.strip() == "1" else None})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("uid", pa.int64()), ("prefix", pa.string()), ("truth", pa.list_(pa.int64()))]))

    return spark.read.text(path, wholetext=True).mapInArrow(parse, "uid long, prefix string, truth array<bigint>")


# Raw datasets -> (edges, attributes)


def dblp(spark: SparkSession, edges_path: str, nodes_path: str) -> tuple[DataFrame, DataFrame]:
    """Edges tab-separated; nodes as name, id."""
    nodes = tsv(spark, nodes_path, "name string, uid long")
    return edges(spark, edges_path).distinct(), nodes.select("uid", lower_ascii(F.col("name")).alias("name"))


def livejournal(spark: SparkSession, edges_path: str, names_path: str) -> tuple[DataFrame, DataFrame]:
    """Edges separated by white space below header lines, which begin with a % or #; names as name|id."""
    lines = spark.read.text(edges_path).where(~F.trim("value").rlike("^[%#]") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    pairs = lines.select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))
    named = F.split("value", r"\|")
    names = spark.read.text(names_path).select(F.get(named, F.lit(1)).cast("long").alias("uid"), lower_ascii(F.get(named, F.lit(0))).alias("name"))
    return pairs.distinct(), names


def twitter(spark: SparkSession, edges_path: str, names_path: str) -> tuple[DataFrame, DataFrame]:
    """Edges inverted; names as id and name separated by white space, ASCII only."""
    pairs = edges(spark, edges_path).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = F.split(F.trim("value"), r"\s+", 2)
    names = spark.read.text(names_path).select(F.get(parts, F.lit(0)).cast("long").alias("uid"), lower_ascii(F.get(parts, F.lit(1))).alias("name"))
    return pairs.distinct(), names.where("name is not null").where(is_ascii(F.col("name")))
