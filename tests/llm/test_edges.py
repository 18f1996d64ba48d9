"""Very long texts, clashing column names and empty tables, for the operators and stages whose own tests have none."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from ticketlens.llm.counts import Rollup, maintained
from ticketlens.llm.mixing import mixed
from ticketlens.llm.nearcopies import near_copies
from ticketlens.llm.quality import Chain, held_out, line_features, scored, train
from ticketlens.llm.repeats import without_repeats
from ticketlens.llm.rules import measured, passed
from ticketlens.llm.simhash import fingerprint, near_duplicates
from ticketlens.llm.tokens import read_tokens, tokenizer_path, write_tokens

WORDS = 200_000


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two texts of 200,000 words that differ in one, an exact copy, a short text that is part of them, nulls and empties."""
    rng = random.Random(12)
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randrange(900)) for _ in range(WORDS)]
    other = [*words[:-1], "changed"]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words)), (4, " ".join(words[500:540])), (5, None), (6, ""), (7, "lone words here")]
    return rows, spark.createDataFrame([(d, t, "s", "en") for d, t in rows], "doc_id long, text string, source string, lang string").repartition(3)


def test_tokens_of_long_texts(spark, long_docs):
    rows, docs = long_docs
    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    got = {r.doc_id: r for r in read_tokens(spark, write_tokens(docs), digest_only=True).collect()}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_fingerprints_of_long_texts(long_docs):
    rows, docs = long_docs
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    words = rows[0][1].split()
    bits = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        bits += (np.uint64(h) >> np.arange(64, dtype=np.uint64)).astype(np.int64) & 1
    want = sum(1 << b for b in range(64) if 2 * bits[b] > len(words) - 2)
    assert got[1][0] == f"{want:016x}" and got[2][1] == got[3][1] == 1 and fingerprint(rows[0][1]) & (1 << 64) - 1 == want


def test_near_copies_of_long_texts(long_docs):
    rows, docs = long_docs
    got = {r.doc_id: r.component_id for r in near_copies(docs.select("doc_id", "text")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_repeats_in_long_texts(long_docs):
    rows, docs = long_docs
    got = {r.doc_id: r.n_removed for r in without_repeats(docs).collect()}
    assert got == {1: 0, 2: WORDS - 1, 3: WORDS, 4: 40, 5: 0, 6: 0, 7: 0}


def test_measures_counts_and_mix_of_long_texts(spark, long_docs):
    rows, docs = long_docs
    sizes = {d: len((t or "").split()) for d, t in rows}
    assert {r.doc_id: r.n_words for r in measured(docs).collect()} == sizes
    assert {r.doc_id: r.size for r in mixed(docs).collect()} == sizes
    tokenizer = Tokenizer.from_file(tokenizer_path())
    totals = {r.tokenizer: r.n_tokens for r in maintained(docs, Rollup(spark)).collect()}
    kept = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows if d not in (3, 6)]
    assert sorted(totals.values()) == [sum(kept) + len(kept)]


def test_scores_of_long_texts(long_docs):
    rows, docs = long_docs
    features, _, counts = line_features(pa.array(["good line.\nanother one.", "#### @@@\n%% $$"]))
    model = train(features, counts, np.array([1, 0]), steps=3)
    assert isinstance(model, Chain) and held_out is not None
    got = {r.doc_id: r.score for r in scored(docs, model).collect()}
    assert got.keys() == {d for d, _ in rows} and all(0 <= s <= 1 for s in got.values()) and got[1] == got[3]


CLASH = "doc_id long, text string, _rid long, u long, n string, component_id int, unit string, start string, fp long, key long, source string"


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "and", "of", "with", "that"] + [f"w{i}" for i in range(300)], k=80)) for _ in range(12)]
    rows = [(i, t, -i, i * 10, "n", None, "u", "s", 1, 2, "src") for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, CLASH)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        kept = {r.doc_id: tuple(r) for r in out.collect()}
        assert all(kept[d] == rows[d] for d in kept)
    assert kept.keys() == set(range(12))
    tokens = corpus_pipeline.token_files(spark, docs, "")
    assert sorted(r.doc_id for r in tokens.collect()) == list(range(13))


def test_empty_tables_in_every_stage_and_in_the_whole_run(spark, tmp_path):
    sf = tmp_path / "empty"
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([], schema).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, "some item of a benchmark that has a few words")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(sf)).count() == 0, name
    assert corpus_pipeline.run(spark, str(sf), str(tmp_path / "run")).count() == 0
    assert passed(docs).count() == 0
