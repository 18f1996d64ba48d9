import random

from ticketlens.llm.simhash import close_pairs, fingerprint, near_duplicates


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_close_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(4):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            values.add(x)
    base = rng.getrandbits(64)
    values |= {base ^ i for i in range(40)}  # many under one node
    values = sorted(values)
    frame = spark.createDataFrame([(signed(v),) for v in values] * 2 + [(None,)], "fp long")
    got = {frozenset((r.fp_a & (1 << 64) - 1, r.fp_b & (1 << 64) - 1)) for r in close_pairs(frame).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    assert got == want


def test_fingerprint_by_definition():
    import xxhash

    for text in ("One two  three\nfour five", "a", "a b", "É a É b É c d", "x " * 10000):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert fingerprint(text) & (1 << 64) - 1 == want
    assert fingerprint("") == fingerprint(None) == fingerprint(" \n") == 0


def test_components_nulls_and_repeats(spark):
    rows = [(5, "a b c d", "x"), (3, "a  B c\td", "x"), (3, "a b c d", None), (None, "a b c d", "x"), (9, None, "y"), (8, "", "y"), (7, "quite different words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
