import pytest
from pyspark.sql import functions as F

from ticketlens.functions import dates as D
from ticketlens.functions.text import clean_text, parse_notes, root_cause, tokens, truncate
from ticketlens.sources import sinks, tickets as S


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Number,Short description,Opened,assigned_to.email,Extra\nINC1,\"Café – \"\"x\"\"\nline\",2025-03-04 10:00:00,a@b.c,1\n".encode())
    (tmp_path / "b.csv").write_bytes("Number,Short description,Opened,Extra\nINC2,Caf\xe9 \x96 \x80,2025-03-05 10:00:00,2\n".encode("latin-1"))
    df = S.read_csv(spark, str(tmp_path))
    rows = {r.number: r for r in S.canonical(S.drop_email_columns(df), F.monotonically_increasing_id()).collect()}
    assert rows["INC1"].short_description == 'Café – "x"\nline' and rows["INC2"].short_description == "Café – €"
    assert rows["INC1"].task_type == "Incident" and rows["INC1"].made_sla is None and rows["INC1"].service is None
    assert "assigned_to.email" not in df.columns or "assigned_to.email" not in S.drop_email_columns(df).columns
    assert rows["INC2"].Extra == "2" and S.unmapped_columns(df) == ["Extra"]


def test_day_month_dates(spark):
    make = lambda m: lambda c: D.normalize_date(c, F.lit(m))
    assert one(spark, make(False), "13/03/2025", "04/03/2025", "12/31/2025 11:05 PM", "31/02/2025", "", "2025-01-02") == ["2025-03-13 00:00:00", "2025-03-04 00:00:00", "2025-12-31 23:05:00", "31/02/2025", "", "2025-01-02"]
    assert one(spark, make(True), "04/03/2025", "13.03.2025 12:10 am") == ["2025-04-03 00:00:00", "2025-03-13 00:10:00"]
    assert spark.range(1).select(D.serial_date(F.lit(46291.9687037037))).first()[0][11:] == "23:14:56"
    votes = spark.createDataFrame([("13/01/2025", "01/02/2025"), ("01/25/2025", "02/26/2025")], "Opened string, Closed string")
    assert S.infer_month_first(votes) is True and S.infer_month_first(votes.limit(1)) is False


def test_times_weeks_and_durations(spark):
    assert one(spark, lambda c: D.timestamp(c).cast("string"), "2025-02-31 25:00:00", "2025/03/04", "x") == ["2025-03-04 01:00:00", "2025-03-04 00:00:00", None]
    assert one(spark, D.week_key, "2024-12-30 00:00:00", "2021-01-03", "") == ["2025-W01", "2020-W53", ""]
    assert one(spark, D.month_key, "on 2025-03-04", "none") == ["2025-03", ""]
    assert one(spark, D.week_label, "2025-W14", "bad") == ["W14 · 31 Mar", "bad"]
    assert one(spark, D.week_range_label, "2025-W14") == ["31 Mar – 6 Apr 2025"]
    hours = spark.createDataFrame([(0.5,), (10.04,), (48.0,), (None,)], "h double").select(D.duration_text(F.col("h"))).collect()
    assert [r[0] for r in hours] == ["30m", "10h", "2d", "—"]


def test_notes(spark):
    journal = "dropped\n2025-01-02 10:00:00 - Ann (Bee) Cee (Work notes)\r\nfirst 2025-01-01 09:00 text\r\r\n01/02/2025 9:15 PM - System (Comments)\nsecond_x000D_2025-01-03 10:00 - Bob (Work notes)\nAttachment added"
    got, plain, blank = one(spark, lambda c: F.coalesce(parse_notes(c), F.array().cast("array<struct<timestamp:string,author:string,text:string,is_system:boolean>>")), journal, "just text", "  ")
    assert [(n.timestamp, n.author, n.text, n.is_system) for n in got] == [("2025-01-02 10:00:00", "Ann (Bee) Cee", "first 2025-01-01 09:00 text", False), ("01/02/2025 9:15 PM", "System", "second", True), ("2025-01-03 10:00", "Bob", "Attachment added", True)]
    assert [(n.author, n.text) for n in plain] == [("Unknown", "just text")] and blank == []


def test_text_functions(spark):
    assert one(spark, clean_text, "a<b>c</b> [code]x[/code] http://u.v/w?x=1 y_x000D_z   q ", None) == ["ac x [URL] y\nz  q", ""]
    assert one(spark, tokens, "INC0012345 - User john.doe@x.y cannot connect to VPN, vpn ñandú 42 ws-4471a") == [["connect", "vpn", "ñandú"]]
    assert one(spark, root_cause, "Hello there. - because: of a bad disk; then fixed", "no reason given") == ["because: of a bad disk;", ""]
    assert one(spark, lambda c: truncate(c, 20), "short  text", "aaaa bbbb cccc dddd eeee", "x" * 30) == ["short text", "aaaa bbbb cccc dddd…", "x" * 20 + "…"]


def test_kinds_checks_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2025-01-01", "7", "x"), ("2", "", "8.5", "")], "Number string, due string, cost string, order_id string")
    assert S.column_kinds(df) == {"due": "date", "cost": "number", "order_id": "text"}
    found = {tuple(r) for r in S.load_checks(df, raw_quotes=3).collect()}
    assert {s for s, _ in found} == {"error", "warning"} and len(found) == 2
    assert S.load_checks(df.limit(0).select("Number")).filter("message LIKE '%no rows%'").count() == 1
    long = spark.createDataFrame([("y" * 40_000,)], "x string").select(F.length(sinks.fit(F.col("x")))).first()[0]
    assert long == 32_767
    sinks.write(df, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    with pytest.raises(ValueError):
        from ticketlens.operators.families import variant

        variant(df, "R1", 0.3)


def test_streaming_weeks(spark, tmp_path):
    from ticketlens.streaming.weekly import weekly_volumes

    spark.createDataFrame([("2025-01-01 10:00:00", "VPN down", ""), ("2025-01-05 10:00:00", "VPN slow", ""), ("2025-03-01 10:00:00", "vpn", ""), ("", "vpn", "")], "opened string, short_description string, description string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("opened string, short_description string, description string").parquet(str(tmp_path / "in"))
    q = weekly_volumes(stream).writeStream.outputMode("append").format("memory").queryName("volumes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("volumes").collect()] == [("2025-W01", "VPN & Remote Access", 2)]


def test_quoted_files_are_split_at_records_whatever_the_blocks(spark, tmp_path):
    """Files cut into splits of a few hundred bytes, in the middle of quoted texts with line breaks and quotes, against the csv module."""
    import csv
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = rng.choice(["plain", 'says "no"', "two\nlines", 'a "quoted\n\nbreak", and more', "", "comma, here", "ends with break\n", '"', "  spaces  "])
        rows.append([f"INC{i}", text * rng.randint(1, 4), f"row {i}"])
    folder = tmp_path / "csv"
    folder.mkdir()
    for name, part, encoding, header in (("a.csv", rows[:200], "utf-8-sig", ["Number", "Description", "Extra"]), ("b.csv", [[a, f"Café – {t}", c] for a, t, c in rows[200:350]], "cp1252", ["Number", "Description", "Extra"]), ("c.csv", [[a, c] for a, _, c in rows[350:]], "utf-8", ["Number", "Other"]), ("d.csv", [["INC9000", "w\nide", "16"]], "utf-16", ["Number", "Description", "Extra"])):
        with open(folder / name, "w", encoding=encoding, newline="") as f:
            csv.writer(f, lineterminator="\r\n" if name == "a.csv" else "\n").writerows([header, *part])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = S.read_csv(spark, str(folder))
            got = sorted((r.Number, r.Description, r.Extra, r.Other) for r in df.collect())
            want = [(a, t, c, "") for a, t, c in rows[:200]] + [(a, f"Café – {t}", c, "") for a, t, c in rows[200:350]] + [(a, "", "", c) for a, _, c in rows[350:]] + [("INC9000", "w\nide", "16", "")]
            assert got == sorted(want)
            if size == "300":
                assert spark.read.text(str(folder / "a.csv")).rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
