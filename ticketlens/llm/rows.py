"""Row identity and words, the same for all operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.plans.shared import checkpoint, numbered

SPACES = "[\\x20\\x09-\\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_list(text: Column) -> Column:
    """The words of a text: runs of characters other than ASCII white space. Null and empty: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}", "")
    parts = F.size(F.split(trimmed, SPACES)).cast("long")
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise(parts - F.when(trimmed.rlike("[\\x20\\x09-\\x0D]$"), 1).otherwise(0))


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``_rid``, doc_id, text and ``columns``: ``_rid`` is unique and ordered as doc_id (null first).

    Where doc_id is unique and never null, as it should be, ``_rid`` is doc_id itself and nothing
    moves. Else rows are numbered by doc_id, then hashes of the text and of ``columns``; rows equal in all are
    interchangeable. The numbers are then held in a checkpoint, as later passes must see the same ones. Any
    share of the rows may have one doc_id or none.
    """
    picked = docs.select("doc_id", "text", *columns)
    rows, distinct = docs.select("doc_id").groupBy("doc_id").count().agg(F.sum("count"), F.count("doc_id")).first()
    if (rows or 0) == distinct:
        return picked.select(F.col("doc_id").cast("long").alias("_rid"), "*")
    order = {"_h": F.xxhash64("text"), "_g": F.xxhash64(*columns) if columns else F.lit(0), "_u": F.monotonically_increasing_id()}
    told = docs.select("doc_id", "text", *columns, *[c.alias(n) for n, c in order.items()])
    return checkpoint(numbered(told, ["doc_id", *order], "_rid").drop(*order))


def folded(docs: DataFrame) -> Column:
    """All columns of ``docs`` but doc_id and text as one struct ``_extra``, so that no name clashes with an operator's own."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    return (F.struct(*extra) if extra else F.lit(None).cast("int")).alias("_extra")


def unfolded(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again; those named in ``new`` take its values if they are there."""
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col("_extra").getField(c).alias(c) for c in docs.columns])
