"""Hard negatives against plain inner products."""

import math
import random

import duckdb
import numpy as np

from ticketlens.llm.negatives import OP12_SQL, Fields, hard_negatives, op12_negatives

COLUMNS = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"


def brute(rows):
    good = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, x, la) in enumerate(good):
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, lb) for j, (b, y, lb) in enumerate(good) if i != j)  # noqa: B905
        for ps, b, lb in [s for s in scored if s[2] == la][:5]:
            fit = [s for s in scored if s[2] != la and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, b, k, c, -ps, -ns) for k, (ns, c, _) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.selectExpr(*COLUMNS.split(", ")).collect())


def test_equal_to_plain_products(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) + (0.3 if i % 10 == k else 0) for k in range(12)], i % 10 if rng.random() < 0.9 else rng.randrange(12)) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 3) for i in range(300)]  # one very common vector
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[51][1], 1), (2000, [], 1), (2050, [0.5], 1), (None, [0.1] * 12, 1), (2100, None, 1), (2150, [0.1] * 11 + [None], 1)]
    rows += [(2200, [float("nan")] * 12, 1), (2250, [float("inf")] * 12, 2), (2300, [0.1] * 12, None), (2350, [-0.2] * 12, 77), (2352, [9.5, -3.25] * 6, 4)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, bucket string, part int").repartition(5)
    floats = [(a, v and [x if x is None else float(np.float32(x)) for x in v], b) for a, v, b in rows]
    assert got(hard_negatives(docs)) == brute(floats)
    assert hard_negatives(docs.limit(0)).count() == 0


def test_fields_hold_any_values():
    rng = np.random.default_rng(2)
    for largest, width in ((1, 3), (300, 64), (40_000, 300), (1 << 24, 5), (1 << 24, 5_000)):
        fields = Fields(width, largest)
        x = rng.integers(-largest, largest + 1, (7, width))
        x[0], a = -largest, x[1]
        if width * largest * largest < 1 << 62:
            assert fields.scores(a.tolist(), fields.integers(fields.packed(x), 7), 7, x.sum(1)).tolist() == (x @ a).tolist()


def test_query_and_statement(spark):
    con = duckdb.connect()
    for table in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{table}/embeddings.parquet'")
        want = sorted(con.sql(f"SELECT {COLUMNS} FROM ({OP12_SQL})").fetchall())
        assert want and got(op12_negatives(spark, table)) == want
        rows = con.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert want == brute(rows)
