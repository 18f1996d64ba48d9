import random
import re

import duckdb

from ticketlens.llm.rules import COLUMNS, OP7_SQL, judged


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "one", "a " * 7, "a " * 8, "a " * 9, "a b c d e f g h " * 4, "x\n\n x\nx\n x", "É ñ# <|>   \x0b \x0c | $5 100%"]
    for _ in range(60):
        words = rng.choices(["the", "of", "Word", "longer-word", "x#", "#", "É!"], k=rng.randint(0, 60))
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_measures_against_brute_force_and_sql(spark):
    rows = [(i, t, "k", True) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = {r.doc_id: tuple(r)[1:7] for r in judged(docs).select(*COLUMNS).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(map(tuple, con.execute(OP7_SQL).fetchall()))
    assert want == sorted(map(tuple, judged(docs).select(*COLUMNS).collect()))


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = judged(docs).select(*COLUMNS).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1 and not got[0].kept
    assert judged(docs.limit(0)).count() == 0
