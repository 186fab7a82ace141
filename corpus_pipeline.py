"""A corpus pipeline of five operators; each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from reelspark.llm.queries import MIX_BLOCK, MIX_REST, MIX_SHARES
from reelspark.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, by a model learnt from all labels of these documents."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id; rows without any word all stay."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets in their texts replaced by the kind of secret; n_chars follows the text."""
    found = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    changed = F.exists("findings", lambda f: f["verdict"] == "live")
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources."""
    return mixing.mix(docs.select(*COLUMNS), MIX_SHARES, MIX_REST, MIX_BLOCK)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("source mixing", mix),
]

#: The classifier and the join are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
