"""The training-text pipeline: toxicity, exact dedup, MinHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet to the shared scratch folder and hands it to the next.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm import exact_dedup, minhash_dedup, packing, suffix_dedup, toxicity
from tallsketch.llm.common import free_name, stored, table

#: Similarity, in a hundred, of near-duplicates (op3's own is minhash_dedup.PERCENT).
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model learns from the labels of the
    documents at hand.  Texts without words get one score, repeated rows stay or go together, other
    columns stay whatever their names, and an empty table gives an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (similarity 0.8 or more) stays."""
    return minhash_dedup.near_dedup(docs, percent=NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in an earlier document go; every document stays."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(docs, "doc_id", packing.words(F.col("text")))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies),
          ("suffix-array dedup", cut_repeats), ("packing", pack)]

#: No SQL: the stages are a trained model, a component search and byte-level removal.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
