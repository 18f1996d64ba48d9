import random
import time

import numpy as np

from ticketlens.llm.decontam import Items, closest, contaminated, edit_distance, edits_allowed, plain, without_contaminated


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 90))] for _ in "ab")
        assert edit_distance(a, b) == slow(a, b)


def edited(words, n, rng, vocabulary):
    out = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice(vocabulary)
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice(vocabulary))
    return out


def brute(texts, items):
    hits = set()
    for d, text in texts:
        words = [p for w in (text or "").split() if (p := plain(w))]
        for t, item in items:
            x = [p for w in item.split() if (p := plain(w))]
            k = edits_allowed(len(x), 0.8)
            if x and any(slow(x, words[s : s + len(x)]) <= k for s in range(len(words))):
                hits.add((d, t))
    return hits


def test_recall_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(t, " ".join(rng.choices(vocabulary, k=rng.randint(1, 45)))) for t in range(12)]
    texts = []
    for d in range(90):
        body = rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 3:
            item = rng.choice(items)[1].split()
            part = edited(item, rng.randint(0, edits_allowed(len(item), 0.8)), rng, vocabulary)
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + rng.choice(["", "!!", "###"]) for w in part]
        texts.append((d, " ".join(body)))
    texts += [(500, None), (501, ""), (None, items[-1][1])]
    docs = spark.createDataFrame([(*x, "z") for x in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    want = brute(texts, items)
    assert got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))
    blocks = {(r.doc_id, r.item_id) for r in contaminated(docs, bench, most=700).collect()}
    assert blocks <= want and len(blocks) >= 0.95 * len(want)
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_exact_copies_are_always_found():
    rng = random.Random(2)
    words = [[f"v{rng.randrange(500)}" for _ in range(n)] for n in (1, 2, 5, 17, 40, 59)]
    items = Items(list(range(6)), words)
    for t, x in enumerate(items.symbols):
        text = np.array([0, 0, *x, 0], np.uint64)
        assert (0, t, 2, 0) in items.search(text, np.array([len(text)]))


def test_spaces_of_other_kinds_split_items_and_texts(spark):
    rng = random.Random(3)
    items, texts = [], []
    for t, n in enumerate((10, 12, 14, 30)):
        words = [f"u{rng.randrange(900)}" for _ in range(n)]
        for space in ("\u00a0", "\u3000", "\u2009", "\x85"):
            odd = "".join(w + (space if i in (2, 4, 7) else " ") for i, w in enumerate(words)).strip()
            for item, copy in ((odd, odd), (" ".join(words), odd), (odd, " ".join(words))):
                items.append((len(items), item))
                texts.append((len(texts), f"before it {copy} and after it some more words stand here"))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, bench).collect()}
    assert {(d, d, 0) for d, _ in texts} <= got
    assert {(d, t) for d, t, _ in got} <= brute(texts, items)


def test_closest_equals_looking_at_all_starts():
    rng = random.Random(6)
    for _ in range(60):
        item = rng.choices(range(1, 6), k=rng.randint(3, 12))
        text = [x for _ in range(8) for x in (*rng.choices(range(1, 6), k=rng.randint(0, 9)), *edited(item, rng.randint(0, 3), rng, [1, 2, 3]))]
        starts = sorted(rng.sample(range(len(text)), k=len(text) * 2 // 3))
        most, size = rng.randint(0, 6), len(item)
        distance = lambda s, item=item, text=text, size=size: edit_distance(item, text[s : s + size])
        want = []
        for d, s in sorted((distance(s), s) for s in starts):
            if d <= most and all(abs(s - x) >= size for x, _ in want):
                want.append((s, d))
        assert closest(starts, distance, most, size) == want


def test_recall_on_long_items():
    rng, found, total = random.Random(12), 0, 0
    vocabulary = [f"w{i}" for i in range(3000)]
    for n in (60, 150, 400, 1000):
        words = [rng.choices(vocabulary, k=n) for _ in range(8)]
        items = Items(list(range(len(words))), words)
        for t, x in enumerate(words):
            for share in (0, 0.5, 0.9):
                part = edited(x, int(edits_allowed(n, 0.8) * share), rng, vocabulary)
                text = [items.vocabulary.get(w, 0) for w in (*rng.choices(vocabulary, k=80), *part, *rng.choices(vocabulary, k=80))]
                if edit_distance(items.symbols[t], text[80 : 80 + n]) <= items.allowed[t]:
                    total += 1
                    found += any(f[1] == t for f in items.search(np.array(text, np.uint64), np.array([len(text)])))
    assert total > 80 and found >= 0.95 * total, (found, total)


def test_long_repeating_texts_take_linear_time():
    rng = random.Random(3)
    for n, times in ((300, 100), (1000, 100)):
        items = Items([0], [[f"v{rng.randrange(5000)}" for _ in range(n)]])
        text, began = np.array(items.symbols[0] * times, np.uint64), time.time()
        assert items.search(text, np.array([len(text)])) == [(0, 0, n * i, 0) for i in range(times)]
        assert time.time() - began < 20


def test_unrelated_windows_are_rarely_candidates():
    rng = np.random.default_rng(5)
    items = Items(list(range(12)), [[f"v{i}" for i in rng.integers(0, 400, n)] for n in (10, 20, 40, 60) for _ in range(3)])
    text = rng.integers(1, len(items.vocabulary) + 1, 4000).astype(np.uint64)
    for t in range(12):
        starts = np.arange(0, 3900, 7)
        size = np.full(len(starts), items.sizes[t])
        assert (items.embed(text, starts, size, size) == items.item_marks[t]).any(1).mean() < 0.05


def test_stage_with_nulls_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"so {item} it", "a", 5), (None, None, "b", 6), (2, "", "c", None), (2, "clean text of no note", "d", 7), (None, item, "e", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    got = without_contaminated(docs, bench)
    assert got.columns == docs.columns and {r.item_id for r in got.collect()} == {"b", "c", "d"}
    assert without_contaminated(docs, bench.limit(0)).count() == 5
