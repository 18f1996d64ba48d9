"""Records of lines from several blocks, against a reading line by line; texts are written no further time on the way."""

from __future__ import annotations

import random

from ticketlens.sources import tickets


def test_records_span_blocks(spark, monkeypatch):
    draw, rows, expected = random.Random(5), [], []
    for file in ("a", "b", "c"):
        record, quotes, at = 0, 0, 0
        for block in range(0, 60, 10):
            for _ in range(draw.randrange(0, 7)):
                value = draw.choice(("", "x", '"', '""', 'a"b', '"x"y"', 'p","q'))
                if quotes % 2 == 0:
                    record += 1
                    expected.append([file, record, value])
                else:
                    expected[-1][2] += "\n" + value
                rows.append((file, block, at, value))
                quotes, at = quotes + value.count('"'), at + 1
    draw.shuffle(rows)
    monkeypatch.setattr(tickets, "stored", None)  # texts are not written between the sums
    got = tickets._records(spark.createDataFrame(rows, "file string, block long, id long, value string")).collect()
    assert sorted([r.file, r.record, r.text] for r in got) == sorted(expected)
