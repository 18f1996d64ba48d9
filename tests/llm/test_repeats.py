import hashlib
import random

import numpy as np

from ticketlens.llm.repeats import WINDOW, op10_repeats, runs_of, shared_lengths, without_repeats


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract word by word, for small tests."""
    seen: set[tuple[str, ...]] = set()
    out = {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "x,"]
    passages = [" ".join(rng.choices(words, k=n)) for n in (19, 20, 21, 40, 90)]
    rows = []
    for d in range(120):
        body = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(3)]
        if d % 3 == 0:
            body.insert(rng.randint(0, 3), rng.choice(passages))
        if d % 7 == 0:
            body.append(body[0])
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(body)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 4)]
    rows += [(300, "a " * 70), (301, "a b " * 40), (302, ("a b c d e f g h " * 9)), (303, ""), (304, None), (305, "a " * 19), (306, "a " * 20)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = texts(4)
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, marks string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10_repeats(spark, str(tmp_path)).collect()}
    assert got == brute_force(rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "z " + text)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_removed) for r in without_repeats(docs).collect()))
    assert got == [(-1, 0), (1, 25), (1, 25), (2, 25)]
    assert without_repeats(docs.limit(0)).count() == 0


def test_runs_differ_by_order_and_length():
    words = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3, 6, 7, 20):
        got = runs_of(words, n)
        assert len(got) == len(words) - n + 1 and len(set(got.tolist())) == len(got)
        assert (runs_of(words[5:], n) == got[5:]).all()


def test_depths_equal_comparing_neighbours():
    rng = np.random.default_rng(4)
    key, suffixes = rng.integers(0, 3, 300), rng.integers(0, 2, (300, 8)).astype(np.uint64)
    order, depth = shared_lengths(key, suffixes)
    rows = [(int(key[i]), *suffixes[i].tolist()) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 300):
        a, b = rows[k - 1], rows[k]
        want = next((j for j in range(8) if a[j + 1] != b[j + 1]), 8) if a[0] == b[0] else 0
        assert depth[k] == want


def test_hot_prefixes_grow_until_groups_fit(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    phrase = "this very common phrase stands in nearly every one of our texts".split()
    rows = []
    for d in range(160):
        passage = rng.choice([phrase[:7], phrase, phrase + words[:12]])
        rows.append((d, " ".join([*rng.choices(words, k=rng.randint(8, 30)), *passage, *rng.choices(words, k=rng.randint(8, 30))])))
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)] + [(300, "a b " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_force(rows)
    for group in (2, 9, 10_000):
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in without_repeats(docs, group=group).collect()}
        assert got == want, group
