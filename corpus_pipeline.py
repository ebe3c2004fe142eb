"""The corpus pipeline: five stages, each one of the operators of ``rillbase.llm``.

Every stage takes the documents that the one before kept and returns the columns of
``documents``, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillbase.llm import cotraining, decontaminate, packing, simhash, suffixes
from rillbase.llm.common import written
from rillbase.storage import forget, places_so_far

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own score: null and repeated ids as well. Null texts and empty tables are scored as empty."""
    scored = cotraining.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), more=tuple(COLUMNS[1:]))
    return scored.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the least id. Rows with a null id all stay, and rows that share an id go or stay
    together; so do texts without words."""
    dropped = simhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier document has go; so do documents of which nothing is left. Each row keeps its own
    remaining text, also where ids are null or repeat."""
    left = suffixes.remove_repeats(docs, texts=True, more=("lang", "source"))
    return left.where("n_removed = 0 or text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go, each row by its own text."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, null and repeated ids included."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminated), ("packing", pack)]

#: Trained models, suffix sorting and tokenization are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what earlier stages wrote there is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), places_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(spark, mark, keep=1)
    return docs
