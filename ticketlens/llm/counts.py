"""Token counts as rollups that deltas maintain.

A rollup holds additive totals by (source, lang, tokenizer). Inserts count up, deletes count
down, and a revised document is a delete of its old count and an insert of its new one. Each batch is
summed by key before it is written, under its own name; the name is committed when its files are
complete, and a name that is committed is never written again, so a batch may be sent any number of times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.encoder import encoder, slices
from ticketlens.llm.rows import documents, keyed
from ticketlens.llm.tokens import TOKENIZER, tokenizer_path
from ticketlens.plans.shared import checkpoint, shared_dir

KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_ids: int = 0) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row; a null text has no tokens of its own.

    ``end_ids`` is added to each count (a version that closes documents). Other columns are ignored.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch):
                counts = coder.encode(part.column("text"))[1] + end_ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return picked.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(tokenizer))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of counts as inserts (1) or deletes (-1)."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that take the old counts back and put the new ones in."""
    return signed(old, -1).union(signed(new, 1))


class Rollup:
    """A rollup table in a shared folder, one subfolder for each batch."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"

    def _path(self, batch: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self, batch: str) -> bool:
        """Spark's committer marks a folder when all of its files are there."""
        store, path = self._path(batch)
        return store.exists(path.suffix("/_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed rows; false, without work, if a batch of this name is in already.

        A batch that broke off has no mark and is written anew from its start.
        """
        if not batch.isalnum():
            raise ValueError("names of batches are letters and digits")
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; keys at zero are left out."""
        store, path = self._path("x")
        there = [s.getPath() for s in store.listStatus(path.getParent())] if store.exists(path.getParent()) else []
        good = sorted(p.toString() for p in there if store.exists(p.suffix("/_SUCCESS")))
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*good) if good else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def maintained(docs: DataFrame, rollup: Rollup) -> DataFrame:
    """Totals after all of ``docs`` went in, later copies of a text out, and English to a version that counts an end id.

    ``docs`` needs doc_id, text, source, lang. Of rows with equal texts the first by doc_id stays (null first,
    then by a hash of source and lang); rows are told apart by their own number, so null and repeated doc_ids count
    each by themselves. A null text equals an empty one and has no tokens; null sources and languages are keys of their own;
    an empty table gives no totals; other columns are ignored. Equal texts are told by two 64-bit hashes.
    Each batch is sent twice and counts once.
    """
    rows = keyed(docs, F.col("source"), F.col("lang"))
    numbered = rows.select(F.col("_rid").alias("doc_id"), "text", "source", "lang")
    counts = checkpoint(counted(numbered))
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = numbered.select("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    first = checkpoint(marks.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    gone = counts.join(first, "doc_id", "left_anti")
    english = counts.join(first, "doc_id", "left_semi").filter("lang = 'en'")
    revised = english.withColumns({"tokenizer": F.lit(f"{TOKENIZER}+end"), "n_tokens": F.col("n_tokens") + 1})
    for batch, signs in (("load", signed(counts, 1)), ("copies", signed(gone, -1)), ("english", revision(english, revised))) * 2:
        rollup.commit(batch, signs)
    return rollup.totals()


def op6_counts(spark, sf_dir: str) -> DataFrame:
    return maintained(documents(spark, sf_dir), Rollup(spark))
