"""The corpus pipeline: documents in, token files out, in five stages.

Each stage takes what the one before kept, as a DataFrame with the columns of documents, and
returns the same columns; the last returns what it read back from the token files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.decontam import without_contaminated
from ticketlens.llm.mixing import mixed_documents
from ticketlens.llm.nearcopies import near_copies
from ticketlens.llm.rows import documents, folded, keyed, unfolded
from ticketlens.llm.rules import passed
from ticketlens.llm.tokens import read_tokens, write_tokens
from ticketlens.plans.shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return passed(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies: five-word shingles, Jaccard similarity of 0.8."""
    rows = keyed(docs, folded(docs))
    groups = near_copies(rows.select(F.col("_rid").alias("doc_id"), "text"))
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_rid"))
    return unfolded(rows.join(first, "_rid", "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage close to a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, by source weights; a document it takes nothing of is left out."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store; doc_id, start, n_tokens, ids_crc32 as read back from it."""
    return read_tokens(spark, write_tokens(docs), digest_only=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: SQL cannot express fingerprints, edit distance over all windows and the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def _done(spark: SparkSession, path: str) -> bool:
    """Spark's committer marks a folder when all of its files are there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages; each one's rows are written to ``folder``, a new one in the shared folder by default.

    A run that broke off goes on if it is given its folder again: stages whose rows are complete
    are read, not made anew. A folder belongs to one input.
    """
    docs, folder = documents(spark, sf_dir), folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        if not _done(spark, f"{folder}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
