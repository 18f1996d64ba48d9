"""Searches through the index give what a scan gives, and read only the parts that can match."""

import random

from pyspark.sql import functions as F

from ticketlens.operators.search import SearchIndex, grams_of
from ticketlens.plans.filters import searched


def tickets(spark):
    rng = random.Random(5)
    words = ["printer", "Drücker", "VPN", "mail", "100%", "a_b", "x"]
    rows = [(i, f"INC{i:05d}", f"User {i % 7}", " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(["Network", "Desk", "", None]), ("New", "Closed")[i % 2], ("Good", "Poor")[i % 3 == 0]) for i in range(400)]
    rows.append((400, "INC99999", None, "only here: Zebra", "Desk", "New", "Good"))
    return spark.createDataFrame(rows, "row_id long, number string, assigned_to string, short_description string, assignment_group string, state string, label string").selectExpr("* EXCEPT (label)", "named_struct('label', label) AS score")


def test_equal_to_a_scan(spark, tmp_path):
    t = tickets(spark)
    index = SearchIndex.build(t, str(tmp_path / "index"), part_rows=50)
    for text, more in (("zebra", {}), (" PRINT ", {}), ("drück", {"state": "New"}), ("vpn mail", {"label": "Good"}), ("inc0012", {}), ("user 3", {"group": "Desk"}), ("%", {}), ("ma", {}), ("", {}), ("", {"state": "Closed"}), ("nowhere at all", {}), ("100% a_b", {}), ("deskuser", {})):
        want = sorted(r.row_id for r in searched(t, text, **more).collect())
        found = index.search(text, **more)
        assert sorted(r.row_id for r in found.collect()) == want and set(found.columns) == set(t.columns), text


def test_a_rare_text_reads_one_part(spark, tmp_path):
    index = SearchIndex.build(tickets(spark), str(tmp_path / "index"), part_rows=50)
    files = {f.split("_part=")[1].split("/")[0] for f in index.search("zebra").inputFiles() if "_part=" in f}
    assert [tuple(r) for r in index.candidates("zebra").collect()] == [(8, 400)] and index.candidates("ze") is None
    plan = index.search("zebra")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and files


def test_trigrams(spark):
    got = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("äöü",)], "x string").select(grams_of(F.col("x"))).collect()
    assert [sorted(r[0]) for r in got] == [["abc", "bca", "cab"], [], [], [], ["äöü"]]
