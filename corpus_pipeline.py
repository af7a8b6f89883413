"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Toxic documents go; lines of recurring templates go from all but their first
document; one document of each near-duplicate class stays; documents that overlap
a benchmark item go; what is left is packed into sequences. Every stage but the
last returns the columns of ``documents`` (n_chars follows the text).

Cases, of every stage: null and empty texts stay (and are packed as an end id);
rows with a null or repeated doc_id are documents of their own, but equal rows of
one near-duplicate class are one; extra columns pass through whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import decontam, jaccard, lines, packing, toxicity
from chronoframe.llm.base import free_name, materialize, table
from chronoframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from labelled documents of its input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, docs.columns, toxicity.THRESHOLD)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines.

    One that would lose more than half of its characters is a copy as a whole,
    exact or near, and not a document that quotes others: it stays as it is, and
    the next stage judges it.
    """
    dropped = free_name(docs.columns, "n_dropped")
    done = lines.drop_lines(docs, n_dropped=dropped, n_lines=free_name([*docs.columns, dropped], "n_lines"), most=(1, 2))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col(dropped) > 0, size).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram jaccard join", dedup_near), ("decontamination", decontaminate), ("packing", pack)]

#: The trained toxicity model can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
