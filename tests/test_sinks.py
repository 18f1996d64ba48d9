"""Typed cells, repeated numbers, long cells, and sets of sheets that appear whole."""

import pytest
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.sources import sinks as S


def test_serials_of_iso_dates(spark):
    texts = ["1900-01-01", "2025-03-04 12:00", "2025-03-04 06:30:15", "2025-02-31", "2024-13-01", " 2025-03-04 ", "04/03/2025", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(S.as_serial(F.col("x"))).collect()]
    assert got[0] == 2.0 and got[1] == 45720.5 and abs(got[2] - (45720 + (6 * 3600 + 30 * 60 + 15) / 86400)) < 1e-12
    assert got[3] == 45719.0 and got[4] == 45658.0 and got[5] == 45720.0 and got[6:] == [None, None, None]


def tickets(spark):
    score = "named_struct('total', 70, 'label', 'Good', 'dims', named_struct(" + ", ".join(f"'{d}', {i}" for i, d in enumerate(config.DIMS)) + ")) AS score"
    base = spark.createDataFrame([("INC1", "p-1", "2025-01-02", "x" * 40_000, "7", "2025-01-03"), ("INC1", "p-1", "someday", "short", "1e5", "soon"), ("INC2", "p-2", "", "", "", ""), ("INC3", "p-9", "2025-01-02", "", "", "")], "number string, cluster_id string, opened string, description string, cost string, due string")
    other = [c for c in S.CANONICAL if c not in base.columns and c != "made_sla"]
    return base.selectExpr("*", *[f"'{c}' AS {c}" for c in other], "true AS made_sla", "'cat' AS category", "'2025-W01' AS week", "1.5D AS resolution_hours", "false AS is_closed", "'' AS root_cause_text", score, "'mine' AS problem", "'x' AS opened_by")


def test_detail_keeps_repeated_numbers_and_types(spark):
    sheet = spark.createDataFrame([("p-1", "one"), ("p-2", "two")], "cluster_id string, title string")
    out = S.detail_sheet(tickets(spark), sheet, kinds={"cost": "number", "due": "date"})
    rows = sorted(out.collect(), key=lambda r: (r.number, r.opened or 0))
    assert [r.number for r in rows] == ["INC1", "INC1", "INC2"] and "opened_by" not in out.columns and rows[0]["problem (origen)"] == "mine"
    text, dated, blank = rows
    assert (dated.opened, dated.opened_text, dated.cost, dated.cost_text, dated.due) == (45659.0, None, 7.0, None, 45660.0)
    assert (text.opened, text.opened_text, text.cost, text.cost_text, text.due_text) == (None, "someday", None, "1e5", "soon")
    assert (blank.opened, blank.opened_text, blank.description) == (None, None, None)
    assert len(dated.description) == config.CELL_LIMIT and dated.description.endswith("tiene 40000 caracteres; Excel admite 32767]")


def test_detail_has_each_name_once_and_can_be_written(spark, tmp_path):
    sheet = spark.createDataFrame([("p-1", "one"), ("p-2", "two")], "cluster_id string, title string")
    wide = tickets(spark).selectExpr("*", "'a' AS ROOT_CAUSE", "'b' AS due_text", "'c' AS Closed_Text")
    S.write(S.detail_sheet(wide, sheet, kinds={"due": "date"}), str(tmp_path / "detail"))
    rows = spark.read.parquet(str(tmp_path / "detail"))
    assert len({c.lower() for c in rows.columns}) == len(rows.columns)
    one = rows.filter("number = 'INC2'").first()
    assert (one["root_cause"], one["root_cause_text"], one["ROOT_CAUSE (origen)"], one["Closed_Text (origen)"]) == (config.DIMS.index("root_cause"), "", "a", "c")
    assert {"b"} == {r["due_text (origen)"] if "due_text (origen)" in rows.columns else r["due_text"] for r in rows.collect()}


def test_detail_query_against_its_statement_as_a_table(spark, tmp_path):
    import duckdb

    from ticketlens.plans.catalog import QUERIES, SQL

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "events", "orders", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {SQL['detail_sheet']}")
    QUERIES["detail_sheet"](spark, sf).write.parquet(str(tmp_path / "detail"))
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/detail/*.parquet'")
    kinds = {n: dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {n})").fetchall()) for n in ("want", "got")}
    assert kinds["want"] == kinds["got"]
    columns = ", ".join(sorted(kinds["want"]))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone()[0] == 0
    assert con.execute("SELECT count(*) FROM got").fetchone()[0] > 0


def test_sheets_appear_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "export")
    assert S.read_set(spark, path) == {}
    one = spark.range(3)
    S.write_set({"problems": one, "detail": one.select((F.col("id") * 2).alias("id"))}, path)
    broken = one.select(F.raise_error(F.lit("the second sheet breaks")).alias("id"))
    with pytest.raises(Exception, match="second sheet breaks"):
        S.write_set({"problems": one.limit(1), "detail": broken}, path)
    old = S.read_set(spark, path)
    assert {k: sorted(r.id for r in v.collect()) for k, v in old.items()} == {"problems": [0, 1, 2], "detail": [0, 2, 4]}
    S.write_set({"problems": one.limit(1), "detail": one, "metadata": one}, path)
    assert {k: v.count() for k, v in S.read_set(spark, path).items()} == {"problems": 1, "detail": 3, "metadata": 3}
