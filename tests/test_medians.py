"""Medians against sorting, and facets from one scan against one filter each."""

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from ticketlens.operators.medians import medians, with_median


def test_medians_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 3), rng.choice([None, 0.0, -2.5, rng.gauss(0, 1), rng.gauss(0, 1) * 10**9, float(rng.randint(-3, 3)), 1e-9, 0.1 * rng.randint(0, 20)])) for _ in range(3_000)]
    rows += [("hot", 0, 7.25)] * 2_000 + [("hot", 0, 1.0)] * 1_999 + [("two", 0, 1.0), ("two", 0, 2.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(6)
    for by in (["k"], ["k", "j"], []):
        values = defaultdict(list)
        for r in rows:
            if r[2] is not None:
                values[tuple(dict(zip(("k", "j"), r, strict=False))[c] for c in by)].append(r[2])
        got = {tuple(r[c] for c in by): r["median"] for r in medians(df, by, F.col("v")).collect()}
        assert got.keys() == values.keys() and all(abs(got[k] - statistics.median(v)) <= 1e-12 * abs(got[k]) + 1e-300 for k, v in values.items())
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = {r.k: r.m for r in with_median(groups, df, ["k"], F.col("v"), "m").collect()}
    assert set(joined) == {"a", "b", None, "hot", "two", "none"} and joined["none"] is None and joined["hot"] == 7.25 and joined["two"] == 1.5
    assert with_median(df.limit(0).agg(F.count("*").alias("n")), df.limit(0), [], F.col("v"), "m").collect() == [(0, None)]
    assert medians(df.limit(0), ["k"], F.col("v")).count() == 0


def test_no_state_holds_more_than_a_bucket(spark):
    """A group of 50,000 distinct values is dealt by buckets; no (group, bucket) holds over a few hundredths of it."""
    from ticketlens.operators.medians import _bucket

    df = spark.range(50_000).select((F.col("id") * 0.37).alias("v"))
    assert df.groupBy(_bucket(F.col("v"))).count().agg(F.max("count")).first()[0] < 0.02 * 50_000
    assert abs(medians(df, [], F.col("v")).first()[0] - 0.37 * 49_999 / 2) < 1e-9
