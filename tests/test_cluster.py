import random
from collections import Counter

from ticketlens.operators.cluster import cluster
from ticketlens.operators.families import cosine_edges, families
from ticketlens.operators.graph import connected_components


def sequential(rows):
    """The rule row by row, without a limit on candidates."""
    df = Counter(t for _, _, tokens in rows for t in tokens)
    ceiling, leaders, index, out = max(2, int(len(rows) * 0.2)), [], {}, {}
    for i, (row_id, category, tokens) in enumerate(rows):
        if not tokens:
            out[row_id] = f"solo-{i}"
            continue
        shared = {}
        for t in tokens:
            for b in index.get(t, ()):
                shared[b] = shared.get(b, 0) + 1
        best, score = -1, 0.5
        for b, _ in sorted(shared.items(), key=lambda x: -x[1]):
            other, c = leaders[b]
            both = len(set(tokens) & set(other))
            near = both / (len(tokens) + len(other) - both)
            if c == category and near > score:
                best, score = b, near
        if best < 0:
            best = len(leaders)
            leaders.append((tokens, category))
            for rank, t in enumerate(sorted(tokens, key=lambda t: df[t])):
                if rank < 2 or df[t] <= ceiling:
                    index.setdefault(t, []).append(best)
        out[row_id] = f"p-{best}"
    return out


def test_equal_to_the_sequential_rule(spark):
    for seed in range(3):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(rng.choice([9, 25]))]
        rows = []
        for i in range(150):
            tokens = list(dict.fromkeys(rng.choices(words, k=rng.randint(0, 6))))
            rows.append((i * 3 + 1, rng.choice("ab"), tokens))
        frame = spark.createDataFrame(rows, "row_id long, category string, tokens array<string>")
        got = {r.row_id: r.cluster_id for r in cluster(frame).collect()}
        assert got == sequential(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cosine_edges_against_all_pairs(spark):
    import math

    rng = random.Random(7)
    words = [f"word{i}" for i in range(14)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 7)))) for i in range(60)]
    feats = []
    for _, t in texts:
        w = [x for x in t.split() if len(x) > 1]
        feats.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    df = Counter(f for c in feats for f in c)
    vectors = []
    for c in feats:
        v = {f: (math.log(n) + 1) * (math.log((len(texts) + 1) / (df[f] + 1)) + 1) for f, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({f: x / size for f, x in v.items()})
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if vectors[i] and vectors[j] and sum(x * vectors[j].get(f, 0) for f, x in vectors[i].items()) >= 0.6 - 1e-9}
    frame = spark.createDataFrame(texts, "row_id long, text string")
    edges = cosine_edges(frame, 0.6)
    reach = {(r.src, r.dst) for r in edges.collect()}
    assert reach <= want
    fam = {r.row_id: r.family for r in families(frame, edges, 0.6).collect()}
    for i, j in want:  # identical texts hang together by their first row, so families agree with all pairs
        assert fam[i] is not None and fam[i] == fam[j]
