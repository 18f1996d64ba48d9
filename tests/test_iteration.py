"""Iterations over tables: sizes that the planner guesses stay those of the data, and long chains end."""

import random

from pyspark.sql import functions as F

from ticketlens.operators.cluster import _leaders
from ticketlens.operators.graph import connected_components
from ticketlens.plans.shared import forget, stored


def guessed_bytes(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_guessed_sizes_do_not_grow_over_fifty_rounds(spark):
    state = stored(spark.range(200).select("id", (F.col("id") % 7).alias("g")))
    first = guessed_bytes(state)
    for _ in range(50):
        least = state.groupBy("g").agg(F.min("id").alias("m"))
        before, state = state, stored(state.join(least, "g").join(least.withColumnRenamed("m", "o"), "g").select("id", "g"))
        forget(before)
    assert state.count() == 200 and guessed_bytes(state) < 4 * first < 2**20


def test_a_path_of_a_hundred_thousand_nodes(spark):
    order = list(range(100_000))
    random.Random(3).shuffle(order)
    got = connected_components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")).agg(F.count("*"), F.count_distinct("node"), F.max("component")).first()
    assert tuple(got) == (100_000, 100_000, 0)


def test_a_chain_of_sixty_dependent_leaders(spark):
    sets = spark.range(62).select(F.col("id").alias("sid"))
    chain = [(i, i + 1, True) for i in range(60)] + [(60, 61, False)]
    got = {r.sid for r in _leaders(sets, spark.createDataFrame(chain, "a long, b long, b_sees_a boolean")).collect()}
    assert got == {*range(0, 61, 2), 61}


def test_folders_go_early_or_with_the_application(tmp_path):
    """In a session of its own: what is forgotten goes at once, the rest when it ends."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from ticketlens.plans.shared import forget, scratch, stored
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()
a, b = stored(spark.range(3)), stored(spark.range(4))
spark.range(2).write.parquet(scratch(spark, 'index') + '/rows')
import os
made = lambda: len([f for f in os.listdir({str(tmp_path)!r}) if f.startswith(('stored-', 'index-'))])
before = made()
forget(a, None, spark.range(1))
print('FOUND', before, made(), b.count())
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    assert "FOUND 3 2 4" in out and not [f for f in os.listdir(tmp_path) if f.startswith(("stored-", "index-"))]
