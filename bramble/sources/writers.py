"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Names and prefixes may begin or end with spaces, and be empty.
_WHOLE = {"sep": "\t", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def dictionary(ids: DataFrame, path: str) -> None:
    """Numbers and names in name order, in ranges."""
    ids.select("sid", "name").repartitionByRange("sid").sortWithinPartitions("sid").write.mode("overwrite").parquet(path)


def results(rows: DataFrame, path: str) -> None:
    rows.select("iteration", "user_id", "query", "l", "r", "results", "prefix_ns", "inter_ns").write.mode("overwrite").options(**_WHOLE).csv(path)


def queries(rows: DataFrame, path: str, verification: bool = True) -> None:
    rows.select("qid", "uid", "prefix", *(["truth"] if verification else [])).write.mode("overwrite").json(path)


def query_files(rows: DataFrame, path: str, verification: bool = True) -> None:
    """Query files in lines, a user's queries together: flag, user, number of queries; each prefix, and with verification the number of results and the results."""
    told = F.array_join(F.concat(F.array("prefix", F.size("truth").cast("string")), F.col("truth").cast("array<string>")), "\n") if verification else F.col("prefix")
    users = rows.select("uid", F.struct("prefix", told.alias("told")).alias("q")).groupBy("uid").agg(F.array_sort(F.collect_list("q")).alias("q"))
    head = [F.lit("1" if verification else "0"), F.col("uid").cast("string"), F.size("q").cast("string")]
    users.select(F.array_join(F.concat(F.array(*head), F.transform("q", lambda x: x["told"])), "\n").alias("value")).write.mode("overwrite").text(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def edges(rows: DataFrame, path: str) -> None:
    """Tab-separated src, dst in order, gzipped."""
    rows.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").options(**_WHOLE).option("compression", "gzip").csv(path)


def attributes(rows: DataFrame, path: str) -> None:
    """Tab-separated uid, name, gzipped."""
    rows.select("uid", "name").write.mode("overwrite").options(**_WHOLE).option("compression", "gzip").csv(path)


def latex(rows: DataFrame) -> str:
    """A report's rows, which are few, as a table."""
    put = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    lines = [" & ".join(map(put, line)) + r" \\" for line in [rows.columns, *rows.collect()]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
