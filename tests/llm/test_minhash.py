"""MinHash components against the similarities of all pairs."""

import random
from itertools import combinations

import numpy as np

from ticketlens.llm.minhash import MINIMA, band_keys, band_rows, minima, near_duplicates, op13_minhash, similar_groups

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size=5, hundredths=85):
    sets, parent = {i: shingles(t, size) for i, (_, t) in enumerate(rows)}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= hundredths * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return [(d, len(sets[i]), rows[find(i)][0], find(i) == i) for i, (d, _) in enumerate(rows)]


def texts():
    rng, out = random.Random(4), [None, "", " \n", None, "one", "One", "one two three four", "ONE two three\tfour"]
    words = [f"w{i}" for i in range(3000)]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(6, 200))
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    base = rng.choices(words, k=100)
    for i in range(90):  # one or two changed words each: many similar to the base, few to one another
        out.append(" ".join(w if j not in (i, i * 7 % 100) else f"x{i}" for j, w in enumerate(base)))
    out += ["a b c d e f g h"] * 30 + [" ".join(rng.choices(words, k=30_000))] * 2
    return out


def answer(found):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id is not None, r.component_id or 0, r.kept) for r in found.collect())


def order(rows):
    return sorted((d is not None, d or 0, n, c is not None, c or 0, k) for d, n, c, k in rows)


def test_components_equal_all_pairs(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, component string").repartition(3)
    assert answer(near_duplicates(docs)) == order(brute(rows))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_small_cells_and_other_parameters_give_the_same(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, similarity, block in ((5, 0.85, 4), (2, 0.7, 16)):
        want = {d: c for d, _, c, _ in brute(rows, size, round(similarity * 100))}
        assert {r.doc_id: r.component_id for r in similar_groups(docs, size, similarity, block=block).collect()} == want


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, None), (3, text), (3, text + " i"), (5, "p q r s t u"), (5, "p q r s t u")]
    got = answer(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [x[:3] for x in got] == [(False, 0, 0), (False, 0, 4), (True, 3, 4), (True, 3, 5), (True, 5, 2), (True, 5, 2)]
    assert sum(x[-1] for x in got) == 4  # three linked by the first text (0.8 to the longer one is no link), the pair, one empty, the longer one


def test_query_on_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert answer(op13_minhash(spark, SF)) == order(brute(rows))


def test_share_of_equal_minima_and_bands():
    rng = np.random.default_rng(1)
    common, a, b = rng.integers(0, 1 << 63, (3, 850), np.uint64)
    x, y = minima(np.concatenate([common, a[:75]])), minima(np.concatenate([common, b[:75]]))
    assert abs((x == y).mean() - 0.85) < 0.08 and len(x) == MINIMA
    assert band_rows(0.85) == 7 and band_rows(0.8) == 6 and band_rows(0.5) == 2
    assert (band_keys(x, 7) == band_keys(y, 7)).any() and not (band_keys(x, 7) == band_keys(minima(a), 7)).any()
