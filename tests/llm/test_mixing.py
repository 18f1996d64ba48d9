import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ticketlens.llm.mixing import _permuted, mixed, mixed_blocks, mixed_documents


def rows(seed=1):
    rng = random.Random(seed)
    sizes = {"a": 9000, "b": 300, "c": 2500, "d": 40, None: 5000, "é": 1}
    out, d = [], 0
    for s, total in sizes.items():
        while total > 0:
            n = min(total, rng.choice([0, 1, 5, 60, 700]))
            out.append((d, " ".join(f"w{d}.{i}" for i in range(n)) or rng.choice([None, "", " "]), s, "en", 7))
            total -= max(n, 0)
            d += 1
    rng.shuffle(out)
    return out


def water(sizes):
    """Targets by repeated rounds, as the contract says them."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        share = sum(weight[s] for s in names if s not in capped)
        now = {s: left * weight[s] / share for s in names if s not in capped}
        over = {s: 3.0 * sizes[s] for s in now if now[s] > 3 * sizes[s]}
        if not over:
            return {**capped, **now}
        capped |= over


def test_targets_caps_and_reruns(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.doc_id: r for r in mixed(docs, block=16).collect()}
    sizes = Counter()
    for d, t, s, *_ in data:
        sizes[s] += len((t or "").split())
    want, taken = water(sizes), Counter()
    for d, t, s, *_ in data:
        r = got[d]
        assert r.size == len((t or "").split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 32
    again = {r.doc_id: r.taken for r in mixed(docs.repartition(7), block=16).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_blocks_hold_the_words(spark):
    data = rows(3)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long")
    blocks = mixed_blocks(docs, block=16).collect()
    from_blocks = Counter(w for r in blocks for w in r.words)
    taken = {r.doc_id: r.taken for r in mixed(docs, block=16).collect()}
    by_doc = Counter()
    for w, n in from_blocks.items():
        by_doc[int(w[1:].split(".")[0])] += n
    assert by_doc == Counter({d: n for d, n in taken.items() if n})
    assert all(len(r.words) <= 16 for r in blocks)
    out = {r.doc_id: r for r in mixed_documents(docs, block=16).collect()}
    assert set(out) == {d for d, n in taken.items() if n}
    for d, r in out.items():
        assert Counter(r.text.split()) == Counter({w: n for w, n in from_blocks.items() if w.startswith(f"w{d}.")})
        assert r.n_chars == len(r.text)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(_permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 60 or got != list(range(n)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert mixed(docs).count() == 0 and mixed_documents(docs).count() == 0
    one = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "a b c", None)], "doc_id long, text string, source string")
    assert sorted((r.size, r.taken) for r in mixed(one, block=1).collect()) == [(0, 0), (0, 0), (3, 3)]


def test_shards_are_multinomial_draws_that_the_mix_takes(spark):
    data = [(d, " ".join(f"w{d}.{i}" for i in range(160)), s, "en", 7) for d, s in enumerate(["a"] * 120 + ["b"] * 120 + ["c"] * 120)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long")
    slots, block = 50, 4
    blocks = mixed_blocks(docs, block=block, shard_slots=slots).select("shard", "source", "t", "block").collect()
    shards = defaultdict(Counter)
    for r in blocks:
        shards[r.shard][r.source] += 1
    total = len(blocks)
    assert total == 360 * 160 // block and all(sum(c.values()) == slots for c in shards.values())
    share = {"a": 1 / 6, "b": 2 / 6, "c": 3 / 6}
    # each shard's counts against the weights: the sum of chi-squares has 2 degrees of freedom a shard
    chi = sum((c[s] - slots * p) ** 2 / (slots * p) for c in shards.values() for s, p in share.items())
    free = 2 * len(shards)
    assert abs(chi - free) < 5 * (2 * free) ** 0.5, (chi, free)
    assert len({c["a"] for c in shards.values()}) > 5  # drawn, not dealt evenly
    for s, n in (("a", 120 * 160 / 3 / 4 * 1.5), ("b", 120 * 160 / 4), ("c", 120 * 160 / 4 * 1.5)):
        ts = [r.t for r in blocks if r.source == s]
        assert sorted(ts) == list(range(len(ts))) and abs(len(ts) - n) <= 1
    taken = {r.doc_id: r.taken for r in mixed(docs, block=block, shard_slots=slots).collect()}
    by_doc = Counter()
    for r in blocks:
        by_doc[(120 * "abc".index(r.source)) + r.block * block // 160, r.source] += block
    assert sum(taken.values()) == sum(by_doc.values())
    per = Counter()
    for (d, s), n in by_doc.items():
        per[s] += n
    assert per == Counter({s: sum(taken[d] for d, _, x, *_ in data if x == s) for s in "abc"})


def test_slots_are_made_in_many_tasks(spark):
    wanted = spark.createDataFrame([(1, 90_000), (2, 10_000)], "k int, slots long")
    from ticketlens.llm.mixing import TASK_SLOTS, drawn

    got = drawn(wanted, 3, 1_000)
    assert got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.max("t").alias("m")).orderBy("k").collect() == [(1, 90_000, 90_000, 89_999), (2, 10_000, 10_000, 9_999)]
    assert f"splits=Some({-(-100_000 // TASK_SLOTS)})" in got._jdf.queryExecution().toString()


def test_clashing_columns(spark):
    rows = [(1, "a b c d", "s", 5, "p", 9, "w"), (None, "e f", None, 6, "q", 9, "w"), (1, None, "s", 7, "r", 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _rid int, pieces string, block int, _words string")
    out = mixed_documents(docs, block=1).collect()
    assert {(r._rid, r.pieces, r.block, r._words) for r in out} <= {(5, "p", 9, "w"), (6, "q", 9, "w")} and len(out) == 2
