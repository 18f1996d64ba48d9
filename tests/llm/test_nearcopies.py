"""Near copies against Jaccard similarities of all pairs."""

import random

import corpus_pipeline
from ticketlens.llm.nearcopies import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def firsts(rows, size=5, similarity=0.8):
    sets, parent = [(d, shingles(t, size)) for d, t in sorted(rows)], {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or len(x & y) >= similarity * len(x | y) - 1e-9 and x & y:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def texts():
    rng, out = random.Random(4), [None, "", " \n", "one", "One", "one two three four"]
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(words, k=12))  # in most texts
    for _ in range(50):
        base = rng.choices(words, k=rng.randint(6, 200))
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) + (f" {line}" if rng.random() < 0.7 else ""))
    base = rng.choices(words, k=60)
    for i in range(70):  # one changed word each: often similar to the base, not to each other
        out.append(" ".join(w if j != i % 60 else f"x{i}" for j, w in enumerate(base)))
    return list(enumerate(out))


def test_components_equal_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, similarity in ((5, 0.8), (2, 0.5)):
        got = {r.doc_id: r.component_id for r in near_copies(docs, size, similarity).collect()}
        assert got == firsts(rows, size, similarity)
    assert near_copies(docs.limit(0)).count() == 0


def test_stage_keeps_the_first_of_near_copies(spark):
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, first in firsts(rows).items() if d == first}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
