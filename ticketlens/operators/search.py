"""Text search through an index of trigrams, so that a search reads only the tickets that can match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.plans.filters import searched
from ticketlens.plans.shared import numbered

#: The columns that a search looks at.
FIELDS = ("number", "assigned_to", "short_description", "assignment_group")
GRAM = 3
#: Tickets of a part, and folders that trigrams are dealt into.
PART_ROWS, BUCKETS = 50_000, 64


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Tickets in parts by row_id, and a posting list for each trigram: which rows of which part have it, in which column."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, t: DataFrame, path: str, part_rows: int = PART_ROWS) -> SearchIndex:
        """Writes the index of ``t`` (row_id unique). Parts are folders that Spark prunes, and so are the buckets of the posting lists."""
        placed = numbered(t, ["row_id"], "_at").withColumn("_part", F.floor(F.col("_at") / part_rows).cast("int")).drop("_at")
        placed.repartition("_part").write.partitionBy("_part").parquet(f"{path}/tickets")
        fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.lower(f).alias("text")) for i, f in enumerate(FIELDS)])).alias("f")
        rows = cls(t.sparkSession, path)._tickets().select("_part", "row_id", fields).select("_part", "row_id", "f.field", F.explode(grams_of(F.col("f.text"))).alias("gram"))
        posts = rows.withColumn("_bucket", _bucket(F.col("gram")))
        posts.repartition("_bucket", "gram").sortWithinPartitions("gram", "_part").write.partitionBy("_bucket").parquet(f"{path}/grams")
        return cls(t.sparkSession, path)

    def _tickets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tickets")

    def candidates(self, text: str) -> DataFrame | None:
        """(_part, row_id) of the rows one of whose columns has all trigrams of the text; None if it is too short to have one."""
        needle = text.strip().lower()
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not grams:
            return None
        buckets = {r.b for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g")).alias("b")).collect()}
        posts = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("_bucket").isin(*buckets) & F.col("gram").isin(*grams))
        return posts.groupBy("_part", "row_id", "field").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("_part", "row_id").distinct()

    def search(self, text: str = "", label: str | None = None, group: str | None = None, state: str | None = None) -> DataFrame:
        """What ``searched`` gives on all tickets, read from the parts that the posting lists name only."""
        found = self.candidates(text)
        rows = self._tickets()
        if found is not None:
            parts = [r._part for r in found.select("_part").distinct().collect()]  # a number for each part at most
            rows = rows.filter(F.col("_part").isin(*parts) if parts else F.lit(False)).join(found, ["_part", "row_id"], "left_semi")
        return searched(rows, text, label, group, state).drop("_part")
