import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from ticketlens.llm.encoder import Encoder
from ticketlens.llm.tokens import read_tokens, tokenizer_path, write_tokens

ODD = ["", " ", "It's they'll DON'T 'S x's", "a1b22 c-3,4 $5.00!!", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ÉÀß ñ Ünï ÿ×÷", "é ΑΣ Σ İstanbul", "日本語 テキスト", "a b c\u0085d", "x\x1cy\x0bz\x0cw\rv", "º ª µ ǅ ﬁ", "\U0001f600ok", "-- ''' '' 'tis rock'n'roll", "\x00\x01 a\x07b"]


def test_words_in_a_row_equal_whole_texts():
    path = tokenizer_path()
    whole, coder, rng = Tokenizer.from_file(path), Encoder(path), random.Random(3)
    alphabet = "abcdeZÉñ'.,!019 \n\t$<|>́"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["word " * 5000]
    ids, counts = coder.encode(pa.array([*texts, None]))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


def test_other_vocabularies_give_the_librarys_ids():
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole, coder = Tokenizer.from_file(path), Encoder(path)
        texts = [t for t in ODD if t] + ["Hello  World, it's\n\n12 o'clock", " lead and trail "]
        ids, counts = coder.encode(pa.array([*texts, None]))
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w], name
        assert coder._by_word == (name == "word_bpe_49k.json")


def test_round_trip(spark):
    rows = [(i * 7 % 101, f"text number {i}, Été {i * i}!\n" * (i % 5), "k") for i in range(101)] + [(None, "none", "k"), (3, None, "k"), (3, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid string").repartition(5)
    store = write_tokens(docs)
    got = sorted(read_tokens(spark, store).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0)) and len(got) == len(rows)
    whole, at = Tokenizer.from_file(tokenizer_path()), 0
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t or "")
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        assert r.ids[-1] == 1 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids[:-1] in [whole.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
    assert at == store.n_tokens
    assert read_tokens(spark, write_tokens(docs.limit(0))).count() == 0


def test_workers_stay_small():
    """What an encoder keeps is bounded, and a task's memory goes back to the system when its last batch is done."""
    import pyarrow.compute as pc

    from ticketlens.llm.encoder import MAX_CODED, giving_back

    coder = Encoder(tokenizer_path())
    for at in range(0, 300_000, 50_000):
        coder.encode(pa.array([" ".join(f"w{n}x" for n in range(at, at + 50_000))]))
    assert max(len(coder._words), len(coder._parts)) <= MAX_CODED + 50_000

    def run(batches):
        for batch in batches:
            held = pc.binary_repeat(pa.array(["x" * 1_000] * 20_000), 10)
            yield batch.slice(0, len(held) and batch.num_rows)

    def anon():
        with open("/proc/self/status") as lines:
            return next(int(x.split()[1]) for x in lines if x.startswith("RssAnon")) / 1024

    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    list(giving_back(run)(iter([batch])))
    before = anon()
    assert sum(b.num_rows for b in giving_back(run)(iter([batch] * 3))) == 6
    assert anon() < before + 60
