"""Exact token-length histogram.

Documents are encoded and counted by length; tasks send one row for each length they
have seen. Sums over the distinct lengths then answer totals, quantiles and truncated
totals for every context limit. Of T tokens there are at most sqrt(2 T) distinct
lengths; they are summed by ranges.

Null and empty texts have length 0; repeated rows and ids each count. Texts of any
length are encoded as a whole. Other columns are ignored. An empty input gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import checkpoint, prefix_sums, sliced, text_of
from bramble.llm.tokens import VOCABULARY, encoder, read_vocabulary


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document."""
    data = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens and n_docs of every length that occurs."""
    data = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(data), Counter()
        for b in sliced(batches):
            seen.update(len(encode(t)) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n"])

    parts = docs.select(text_of().alias("text")).mapInArrow(run, "n_tokens long, n long")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Of every length: documents and tokens of that length, of it or longer, the share of documents up to it, and the tokens left if every document is cut at it.

    Sums run over ranges of lengths first, so no task sees all lengths.
    """
    rows = checkpoint(counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens")))
    docs, tokens = (x or 0 for x in rows.agg(F.sum("n_docs"), F.sum("tokens")).first())
    rows = prefix_sums(rows, {"docs_before": F.col("n_docs"), "tokens_before": F.col("tokens")}, "long", F.col("n_tokens"))
    rows = rows.withColumn("docs_from", F.lit(docs) - F.col("docs_before")).withColumn("tokens_from", F.lit(tokens) - F.col("tokens_before"))
    share = (F.col("docs_before") + F.col("n_docs")) / docs if docs else F.lit(1.0)
    cut = F.col("tokens_before") + F.col("docs_from") * F.col("n_tokens")
    whole = [F.lit(x).cast("long").alias(name) for x, name in ((docs, "all_docs"), (tokens, "all_tokens"))]
    return rows.select("n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", share.alias("share_up_to"), cut.alias("tokens_cut_here"), *whole)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut and tokens_kept of any limits, those between lengths too; one pass over the sums."""
    def over(name: str, limit: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("n_tokens") > limit, F.col(name))), F.lit(0))

    total = F.coalesce(F.max("all_tokens"), F.lit(0))
    rows = [F.struct(F.lit(int(x)).cast("long").alias("context_limit"), over("docs_from", x).alias("docs_cut"), (total - over("tokens_from", x) + over("docs_from", x) * F.lit(int(x)).cast("long")).alias("tokens_kept")) for x in limits]
    return sums.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least that share of documents doesn't exceed."""
    rows = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(F.col("share_up_to") >= x, F.col("n_tokens"))).alias("n_tokens")) for x in shares]
    return sums.agg(F.array(*rows).alias("r")).select(F.inline("r"))
