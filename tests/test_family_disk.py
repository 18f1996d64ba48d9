"""What families move and store, and that names and words of families are whole however their terms are dealt."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import families as M
from ticketlens.plans.shared import stored


def spoken(n, seed=4):
    """Texts of 60 out of 150 sentences."""
    rng = random.Random(seed)
    sentences = [" ".join(f"w{rng.randrange(3_000)}" for _ in range(10)) for _ in range(150)]
    return [" ".join(rng.choices(sentences, k=60)) for _ in range(n)]


@pytest.fixture
def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    return total


def test_terms_move_once_for_a_chunk_of_texts(spark, shuffled):
    """400,000 terms of 400 texts, a few thousand distinct: what moves is texts and distinct terms, not each text's terms."""
    texts = stored(spark.createDataFrame(list(enumerate(spoken(400))), "row_id long, text string").repartition(2))
    before = shuffled()
    assert M.cosine_edges(texts, 0.99).count() == 0
    assert shuffled() - before < 1_500_000


def test_weights_are_made_where_texts_lie(spark, shuffled):
    texts = stored(spark.createDataFrame(list(enumerate(spoken(400))), "row_id long, text string").repartition(2))
    before = shuffled()
    assert M.tfidf(texts).count() > 300_000
    assert shuffled() - before < 500_000


def test_families_store_what_they_read_of_a_ticket(spark):
    from ticketlens.plans import catalog

    t = catalog.family_table(spark.newSession(), "/root/testdata/sf0.001")
    assert tuple(t.columns) == catalog.FAMILY_COLUMNS
    whole = catalog.ticket_table(spark, "/root/testdata/sf0.001").select(*catalog.FAMILY_COLUMNS)
    assert t.count() == whole.count() and t.exceptAll(whole).isEmpty()


def members(spark):
    rng = random.Random(2)
    texts = spoken(40, 9)
    rows = []
    for f in range(6):
        for _ in range((2, 3, 12, 2, 5, 30)[f]):
            words = texts[f].split() if f % 2 else texts[f].split()[:7]
            rows.append((f, " ".join(w if rng.random() > 0.1 else rng.choice(["tokhex", "new", f"own{len(rows)}"]) for w in words)))
    rows += [(3, texts[3])] * 2 + [(None, x) for x in texts[6:]] + [(None, "")]
    rng.shuffle(rows)
    t = spark.createDataFrame([(i, f"INC{i}", x, f"2024-01-{1 + i % 9:02d}") for i, (_, x) in enumerate(rows)], "row_id long, number string, short_desc_clean string, opened string").withColumn("desc_clean", F.lit("")).repartition(3)
    return t, stored(spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)], "row_id long, family long"))


@pytest.mark.parametrize("cell", [300, 1 << 21])
def test_representatives_and_words_equal_sums_over_all_terms(spark, monkeypatch, cell):
    """Sums over written terms, as the statements have them, whatever the parts of a family."""
    t, fam = members(spark)
    weights = M.tfidf(stored(M.variant(t))).join(fam.filter("family IS NOT NULL"), "row_id").toPandas()
    sums = weights.groupby(["family", "term"])["weight"].sum().rename("s").reset_index()
    wide = weights.merge(sums, on=["family", "term"])
    wide["d"] = wide.weight * (wide.s - wide.weight)
    size = weights.groupby("family")["row_id"].nunique()
    close = wide.groupby(["family", "row_id"])["d"].sum().reset_index()
    close["closeness"] = [round(d / (size[f] - 1), 9) for f, d in zip(close.family, close.d, strict=True)]
    monkeypatch.setattr(M, "CELL_TERMS", cell)
    got = {r.family: r for r in M.representatives(t, fam).collect()}
    best = close.groupby("family")["closeness"].max()
    assert set(got) == set(range(6))
    for f, r in got.items():
        assert abs(r.closeness - best[f]) < 2e-9
        assert abs(close[(close.family == f) & (close.row_id == r.row_id)].closeness.iloc[0] - best[f]) < 2e-9
    plain = sums[~sums.term.str.contains(r"(?:^| )tok(?:hex|id|num)(?: |$)")].copy()
    plain["s"] = plain.s.round(9)
    want = {f: list(g.sort_values(["s", "term"], ascending=[False, True]).term[:5]) for f, g in plain.groupby("family")}
    words = {}
    for r in M.common_words(t, fam).orderBy("family", "rank").collect():
        words.setdefault(r.family, []).append(r.term)
    assert words == want


def test_no_text_is_left_behind_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """Chunks of texts go once the pairs are known."""
    from ticketlens.plans import shared

    texts = stored(spark.createDataFrame(list(enumerate(spoken(400))), "row_id long, text string"))
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert M.cosine_edges(texts, 0.99).count() == 0
    assert sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet")) < 100_000
