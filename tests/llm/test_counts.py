from collections import Counter

from tokenizers import Tokenizer

from ticketlens.llm.counts import Rollup, counted, op6_counts, revision, signed
from ticketlens.llm.tokens import TOKENIZER, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_query_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    coder, want, seen = Tokenizer.from_file(tokenizer_path()), Counter(), set()
    for d in sorted(docs, key=lambda d: d.doc_id):
        if d.text in seen:
            continue
        seen.add(d.text)
        end = d.lang == "en"
        want[d.source, d.lang, TOKENIZER + "+end" * end] += len(coder.encode(d.text, add_special_tokens=False).ids) + end
    got = {(r.source, r.lang, r.tokenizer): r.n_tokens for r in op6_counts(spark, SF).collect()}
    assert got == dict(want)


def test_batches_count_once_and_broken_ones_again(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (None, None, None, None), (2, "", "s", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumnRenamed("x", "tokenizer")
    counts, rollup = counted(docs), Rollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", signed(counts, 1)) and not rollup.commit("b1", signed(counts, 1))
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert total() == {("s", "en"): (2, 6), (None, None): (1, 0), ("s", "de"): (1, 0)}
    store, path = rollup._path("b2")
    spark.createDataFrame([("s", "en", "t", 9, 9)], "source string, lang string, tokenizer string, docs long, tokens long").write.parquet(path.toString())
    store.delete(path.suffix("/_SUCCESS"), False)  # as a job that broke off leaves it
    assert total()["s", "en"] == (2, 6)
    rollup.commit("b2", revision(counts.filter("doc_id = 1"), counted(docs.filter("doc_id = 1"), end_ids=1)))
    assert total()["s", "en"] == (2, 8)
    rollup.commit("b3", signed(counts.filter("doc_id = 2 OR doc_id IS NULL"), -1))
    assert set(total()) == {("s", "en")}


def test_query_with_null_repeated_and_empty_rows(spark, tmp_path):
    rows = [
        (None, "only here", "alone", "en"), (None, "twice", "s", "de"), (3, "twice", "s", "de"), (3, "x y", "s", "en"), (3, "x y", "s", "en"), (3, "x y", "t", "en"),
        (4, None, "s", None), (5, "", "s", None), (6, "own", None, "en"), (None, None, None, None),
    ]
    columns = "doc_id long, text string, source string, lang string, tokenizer string, _rid int"
    spark.createDataFrame([(*r, "z", 1) for r in rows], columns).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    coder = Tokenizer.from_file(tokenizer_path())
    tokens = lambda t: len(coder.encode(t or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op6_counts(spark, str(tmp_path / "a")).collect()}
    # one row of each text stays: the first by doc_id, null first; of the three "x y" of document 3, any is the first of source s or t
    xy = [k for k in got if k[0] in ("s", "t") and k[1] == "en"]
    assert len(xy) == 1 and got.pop(xy[0]) == (1, tokens("x y") + 1)
    end = TOKENIZER + "+end"
    assert got == {("alone", "en", end): (1, tokens("only here") + 1), ("s", "de", TOKENIZER): (1, tokens("twice")), (None, "en", end): (1, tokens("own") + 1), (None, None, TOKENIZER): (1, 0)}
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert op6_counts(spark, str(tmp_path / "b")).count() == 0
