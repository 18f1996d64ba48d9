"""Ranked search against plain scoring, and what its bounds skip."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from ticketlens.llm.lexical import OP11_SQL, Queries, Search, op11_lexical, passes, ranked

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "item_id, rank, doc_id, score"


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, length, df = sum(bool(c) for _, c in held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 50 + (50 * c.total() * n) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, k, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(found)[:top], 1)]
    return order(out)


def order(rows):
    return sorted((i is not None, i or 0, k, d is not None, d or 0, s) for i, k, d, s in rows)


def got(df):
    return order(tuple(r) for r in df.selectExpr(*COLUMNS.split(", ")).collect())


def corpus(rng, n=300):
    words = [f"w{i}" for i in range(400)] + ["École", "ß", "x²", "日本語", "naïve", "I", "1"]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 90)))) for i in range(n)]
    docs += [(n + i, "w3, W5;\tw300_w7 " * 3) for i in range(120)]  # ties beyond the last place
    docs += [(1000, None), (1001, ""), (1002, " .,;- \x7f"), (1003, " ".join(rng.choices(words, k=40_000))), (None, "w9 w300 École"), (5, "w300 w300"), (5, "w300 w300")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w300 W5 w3"), (93, "w300 W5 w3"), (None, "w9 École")]
    return docs, items


def test_equal_to_plain_scores(spark):
    docs, items = corpus(random.Random(3))
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, item_id string").repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    assert got(ranked(d, i)) == brute(docs, items, 50)
    assert got(ranked(d, i, 7)) == got(ranked(d, i, 7, skip=False)) == brute(docs, items, 7)
    assert ranked(d.limit(0), i).count() == ranked(d, i.limit(0)).count() == 0


def test_bounds_skip_blocks_and_lose_nothing():
    rng = np.random.default_rng(7)
    queries = Queries()
    for k in range(20):
        queries.add(k, " ".join(f"t{x}" for x in rng.choice(300, 12, replace=False)))
    size = len(queries.vocabulary)
    topics = [rng.choice(size, 25, replace=False) for _ in range(12)]
    vectors = [np.unique(rng.choice(topics[rng.integers(12)], 15)) for _ in range(3_000)]
    lengths, flat = np.array(list(map(len, vectors))), np.concatenate(vectors)
    tf = rng.integers(1, 6, len(flat))
    found = []
    for skip in (True, False):
        search, best = Search(queries, np.bincount(flat, minlength=size), 3_000, 300_000, top=10, skip=skip), {}
        search.shard(best, search.least.copy(), np.arange(3_000), np.arange(3_000), np.full(3_000, 100), lengths, flat, tf)
        found.append({q: best[q][:2].tolist() for q in best})
        if skip:
            assert search.skipped > search.looked > 0
    assert found[0] == found[1] and len(found[0]) == 20


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = corpus(random.Random(4), 120)
    monkeypatch.setattr("ticketlens.llm.lexical.ITEMS", 5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(passes(i))) == 4 and got(ranked(d, i)) == brute(docs, items, 50)


def test_query_and_statement(spark):
    for table in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for name in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{table}/{name}.parquet'")
        want = order(con.sql(f"SELECT {COLUMNS} FROM ({OP11_SQL})").fetchall())
        assert want and got(op11_lexical(spark, table)) == want
