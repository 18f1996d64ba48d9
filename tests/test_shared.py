import random

from pyspark.sql import functions as F

from ticketlens.operators.graph import connected_components
from ticketlens.plans.shared import numbered, spread_join


def test_numbers_follow_the_order_whatever_the_values(spark):
    rng = random.Random(1)
    values = [None] * 30 + [10**15, -(10**15)] + [rng.randint(0, 500) for _ in range(400)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(5)
    got = [(r.n, r.v, r.i) for r in numbered(df, ["v", "i"], "n").collect()]
    want = sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [x[1:] for x in sorted(got)] == want and [x[0] for x in sorted(got)] == list(range(len(values)))
    assert numbered(df.limit(0), ["v", "i"], "n").count() == 0


def test_spread_join_equals_a_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4010, None).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    right = spark.range(1, 40).select(F.col("id").alias("k"), (F.col("id") * 3).alias("x"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = spread_join(left, right, "k", how), left.join(right, "k", how)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), how


def test_components_with_a_hot_centre(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9, 9), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5041), 5000)}
