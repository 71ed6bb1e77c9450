"""A corpus pipeline over documents: quality, near duplicates, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns the mix. Rows with a null doc_id are nobody's duplicate. Rows of one doc_id whose texts
differ are judged each by its text, but for near duplicates, where the id stands for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import Scratch, free_name
from driftwell.llm.decontaminate import uncontaminated
from driftwell.llm.minhash_dedup import near_duplicates
from driftwell.llm.mixing import mix_sources
from driftwell.llm.pseudonyms import pseudonymise
from driftwell.llm.quality_net import accepted
from driftwell.llm.queries import PSEUDONYM_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id."""
    gone = near_duplicates(docs, k=5, percent=80).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    count = free_name(docs, "n_replaced")
    out = pseudonymise(docs, key=PSEUDONYM_KEY, count_col=count)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    changed = F.col(count) > 0
    if kind is not None:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix to target weights takes of it."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pseudonyms", pseudonyms), ("mix", mix)]
ORACLE_SQL = None  # a trained network and a drawn mix; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
