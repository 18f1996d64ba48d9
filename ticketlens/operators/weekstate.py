"""The weekly review from counts that batches keep up to date, so that a new week touches its own and its baseline weeks only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.operators.problems import ranked
from ticketlens.operators.weekly import BASELINE_WEEKS, moved, value_history, volumes_of


@dataclass(frozen=True)
class WeekState:
    """Tickets by (week, key, category), as signed batches in a folder; a batch's name counts once.

    Batches add up: new tickets have sign 1, tickets taken back -1, a changed ticket is both. Weeks are folders, so a review reads the few it needs.
    """

    spark: SparkSession
    path: str
    key: str = "cluster_id"

    def _there(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def commit(self, name: str, tickets: DataFrame, sign: int = 1) -> bool:
        """Adds a batch of tickets (week, key, category); false if the name is known. A batch that broke off is written anew."""
        if self._there(name):
            return False
        kinds = {"week": F.coalesce("week", F.lit("")), "key": F.col(self.key).cast("string"), "category": F.col("category").cast("string")}
        counts = tickets.groupBy(*[c.alias(k) for k, c in kinds.items()]).agg((F.count("*") * sign).alias("n"))
        counts.withColumn("_week", F.col("week")).write.mode("overwrite").partitionBy("_week").parquet(f"{self.path}/{name}")
        return True

    def counts(self, weeks: list[str] | None = None) -> DataFrame:
        """(week, key, category, n) of complete batches; of some weeks only, if given. Undated tickets have a blank week."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        out = self.spark.createDataFrame([], "week string, key string, category string, n long")
        for name in names:
            if self._there(name):
                rows = self.spark.read.schema("week string, key string, category string, n long, _week string").parquet(f"{self.path}/{name}")
                out = out.union((rows if weeks is None else rows.filter(F.col("_week").isin(*weeks))).select("week", "key", "category", "n"))
        return out.groupBy("week", "key", "category").agg(F.sum("n").alias("n")).filter("n <> 0")

    def review(self, week: str, most: int = 8, most_top: int = 10) -> dict[str, DataFrame]:
        """Volume, movements, new, recurring and top problems of a week, as the digest of all tickets has them."""
        weeks = sorted(r.week for r in self.counts().filter("week <> ''").select("week").distinct().collect())  # a value for each week
        base = [w for w in weeks if w < week][-BASELINE_WEEKS:]
        near, one = self.counts([*base, week]), F.col("week") == week
        now = near.filter(one).groupBy("key").agg(F.sum("n").alias("n"))
        known = near.filter(~one).select("key").distinct().withColumn("known", F.lit(True))
        whole = self.counts().join(now.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("_all"), F.count_distinct(F.nullif("week", F.lit(""))).alias("weeks_active"))
        rows = now.join(known, "key", "left").fillna(False, ["known"]).filter("known OR n >= 2").withColumn("kind", F.when(F.col("known"), "recurring").otherwise("new"))
        kept = ranked(rows, ["kind"], F.desc("n"), F.col("key")).filter(F.col("rank") <= most).join(whole, "key")
        active = F.when((F.col("kind") == "recurring") & (F.col("_all") >= 2), F.col("weeks_active")).otherwise(F.lit(1))
        chronic = (F.col("kind") == "recurring") & (F.col("weeks_active") >= config.CHRONIC) & (F.col("_all") >= config.CHRONIC)
        kept = kept.select("kind", "rank", "key", "n", active.alias("weeks_active"), chronic.alias("is_chronic"))
        return {
            "volume": volumes_of(near.groupBy("week").agg(F.sum("n").alias("n"))).filter(one),
            "movements": moved(value_history(near.groupBy("week", F.col("category").alias("value")).agg(F.sum("n").alias("n")))).filter(one),
            "new": kept.filter("kind = 'new'"), "recurring": kept.filter("kind = 'recurring'"),
            "top": ranked(now.filter("n >= 2"), [], F.desc("n"), F.col("key")).filter(F.col("rank") <= most_top).select("rank", "key", "n"),
        }
