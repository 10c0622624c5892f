"""The corpus pipeline: five stages, each an operator of bramble.llm.

Toxic documents go, one document of each group of near duplicates stays, documents
that hold a benchmark item go, sources are mixed to their target weights (documents
repeat or are cut as the mix says), and the mix is packed into rows of token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bramble.llm import mixing, packing, simhash, tiling, toxicity
from bramble.llm.common import checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mixture(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", pack_tokens),
]

#: No SQL: the trees, tiles and token ids are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's copy goes once the next is written, the last stays."""
    docs, at = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{before}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
