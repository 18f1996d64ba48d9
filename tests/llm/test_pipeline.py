"""Each stage of the pipeline against brute force over what the stage before kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_nearcopies import firsts
from tokenizers import Tokenizer

import corpus_pipeline
from ticketlens.llm.decontam import edit_distance, edits_allowed, plain
from ticketlens.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        out.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return [spark.read.parquet(f"{SF}/documents.parquet").collect(), *[d.collect() for d in out]]


def rejected(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    n, chars = len(words), sum(map(len, words))
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)})
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    from ticketlens.llm.rules import STOP_WORDS

    stops, symbols = sum(w.lower() in set(STOP_WORDS) for w in words), sum(c in "#*$%&|<>" for c in text)
    return (
        n < 20 or 100 * repeated > 30 * n or chars < 2 * n or chars > 15 * n or 100 * symbols > 10 * n
        or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or 100 * stops < n or 100 * text.count("!") > 30 * n
    )


def test_rules(stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if not rejected(r.text)}


def test_one_of_each_group_stays(stages):
    """The stage links texts at a Jaccard similarity of 0.8 over five-word shingles (it had op2's 2 bits of three-word shingles before)."""
    first = firsts([(r.doc_id, r.text) for r in stages[1]])
    assert {r.doc_id for r in stages[2]} == {d for d in first if first[d] == d}


def test_no_benchmark_passage_stays(spark, stages):
    items = [[p for w in r.text.split() if (p := plain(w))] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    codes = {}
    coded = [[codes.setdefault(w, len(codes) + 1) for w in x] for x in items]
    wanted = set()
    for r in stages[2]:
        words = [codes.get(p, 0) for w in r.text.split() if (p := plain(w))]
        for x in coded:
            k, own = edits_allowed(len(x), 0.8), set(x)
            hits = np.concatenate([[0], np.cumsum([w in own for w in words])])
            for s in range(len(words)):
                stop = min(len(words), s + len(x))
                if hits[stop] - hits[s] >= len(x) - k and edit_distance(x, words[s:stop]) <= k:
                    wanted.add(r.doc_id)
                    break
    assert {r.doc_id for r in stages[3]} == {r.doc_id for r in stages[2]} - wanted


def test_mix_takes_words_near_the_targets(stages):
    before, sizes = {r.doc_id: r for r in stages[3]}, Counter()
    for r in stages[3]:
        sizes[r.source] += len(r.text.split())
    names = sorted(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    if all(target[s] <= 3 * sizes[s] for s in names):
        taken = Counter()
        for r in stages[4]:
            taken[r.source] += len(r.text.split())
        assert all(abs(taken[s] - target[s]) <= 256 for s in names)
    for r in stages[4]:
        words, own = Counter(r.text.split()), Counter(before[r.doc_id].text.split())
        assert all(n <= 3 * own[w] for w, n in words.items()) and r.n_chars == len(r.text)
    assert len({r.doc_id for r in stages[4]}) == len(stages[4])


def test_token_files(stages):
    coder, at = Tokenizer.from_file(tokenizer_path()), 0
    texts = {r.doc_id: r.text for r in stages[4]}
    for r in sorted(stages[5], key=lambda r: r.start):
        ids = [*coder.encode(texts.pop(r.doc_id), add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not texts


def test_empty_and_repeated_rows(spark):
    from ticketlens.llm.decontam import without_contaminated

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert without_contaminated(docs.limit(0), bench).count() == 0
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0
    one = docs.filter("doc_id = 1")
    odd = one.union(one).union(one.selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.near_dedup(spark, odd, SF).count() == 1


def test_a_broken_run_goes_on_from_its_folder(spark, monkeypatch, tmp_path):
    docs = [(i, f"text number {i} of the small table", "en", f"s{i % 2}", 10) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    calls, broken = [], [True]

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails and broken[0]:
                raise RuntimeError("lost")
            return docs.filter(f"doc_id <> {len(name)}")

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("bb"), stage("ccc", fails=True), stage("dddd")])
    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path / "in"), folder)
    broken[0] = False
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "in"), folder).collect()} == {0, 5}
    assert calls == ["a", "bb", "ccc", "ccc", "dddd"]


def test_rules_stage_with_nulls_ties_and_clashing_columns(spark):
    text = "this is the text of a plain and quite ordinary document that says what it has to say in so many words"
    rows = [(1, text, "a", True, "r"), (1, text, "b", None, None), (None, text, "c", False, "r"), (2, None, "d", True, "r"), (3, "", "e", True, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean, _row string")
    got = corpus_pipeline.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns and {r.n_words for r in got.collect()} == {"a", "b", "c"}
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), SF).count() == 0
