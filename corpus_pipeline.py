"""The corpus pipeline: toxic documents go, one of each group of near copies stays, personal data is masked, sources are mixed to weights, and the rest is packed.

STAGES are applied in order; each takes (spark, docs, sf_dir), and its result
is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshvec.llm import mixing, neardup, packing, pii, queries, toxicity
from meshvec.llm.common import emptied, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The factorization machine learns from the labelled documents; those that it scores 0.7 or more go."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the smallest id of each linked group stays."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base spans and those that the field adds become the name of their kind; n_chars follows."""
    masked = pii.mask_pii(docs, pii.train_pii(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication to the target weights; a document's copies are rows of their own."""
    return mixing.poisson_mix(docs, queries.MIX_WEIGHTS, other=queries.OTHER_WEIGHT, seed=queries.MIX_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit into sequences of 1024 tokens; a row for each piece."""
    return packing.pack_documents(docs, queries.tokenizer_path(), size=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned models and packing have no SQL form; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's table gives its disk back as soon as the next one's is written; the last one is read by the result."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if held is not None:
            emptied(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
