"""The kept weekly state against the digest of all tickets, after appends, repeats and revocations."""

import random

from pyspark.sql import functions as F

from ticketlens.operators.weekly import movements, top_problems, volumes
from ticketlens.operators.weekstate import WeekState


def test_review_after_appends_equals_the_whole(spark, tmp_path):
    rng = random.Random(9)
    weeks = [f"2025-W{w:02d}" for w in (1, 2, 4, 5, 6, 9, 10)]
    rows = [(i, rng.choice([*weeks, ""]), f"p-{min(rng.randrange(12), rng.randrange(12))}", f"cat {rng.randrange(4)}") for i in range(500)]
    t = spark.createDataFrame(rows, "row_id long, week string, cluster_id string, category string")
    state = WeekState(spark, str(tmp_path / "state"))
    old, new = t.filter("week < '2025-W09'"), t.filter("week >= '2025-W09'")
    assert state.commit("old", old) and state.commit("new", new) and not state.commit("new", new)
    assert state.commit("oops", old.limit(50)) and state.commit("oops back", old.limit(50), -1)
    for week in ("2025-W10", "2025-W04", "2025-W01"):
        got, one = state.review(week), F.col("week") == week
        assert got["volume"].collect() == volumes(t).filter(one).collect()
        assert sorted(map(tuple, got["movements"].collect())) == sorted(map(tuple, movements(t).filter(one).collect()))
        assert sorted(map(tuple, got["top"].collect())) == sorted((r["rank"], r.cluster_id, r.n) for r in top_problems(t).filter(one).collect())
        base = [w for w in weeks if w < week][-4:]
        counts = {}
        for _, w, p, _ in rows:
            counts.setdefault(p, {}).setdefault(w, 0)
            counts[p][w] += 1
        for kind in ("new", "recurring"):
            mine = sorted(((-c[week], p) for p, c in counts.items() if week in c and (any(b in c for b in base)) == (kind == "recurring") and (kind == "recurring" or c[week] >= 2)))[:8]
            want = [(k, p, -n, len([w for w in counts[p] if w]) if kind == "recurring" and sum(counts[p].values()) >= 2 else 1) for k, (n, p) in enumerate(mine, 1)]
            assert sorted((r["rank"], r.key, r.n, r.weeks_active) for r in got[kind].collect()) == want
    read = state.counts(["2025-W10"]).inputFiles()
    assert read and {r.week for r in state.counts(["2025-W10"]).collect()} == {"2025-W10"}
    plan = state.counts(["2025-W10"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_week" in plan or "PartitionFilters" in plan
