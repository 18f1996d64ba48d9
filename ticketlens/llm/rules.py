"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule is a row (name, measure, least, most); the table becomes two columns, ``failed_rules``
and ``kept``. No user function, shuffle or second pass: every document is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.rows import documents, word_list

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = sorted(set(
    "the of and to in is that for it was on with as by at are this be or an from have not "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il "
    "el los y del las por con no su para como lo al más o pero sus le ha me si sin sobre".split()
))


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` (SQL over the measures) is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        value = F.expr(self.measure)
        low = F.lit(False) if self.least is None else value < F.lit(self.least)
        high = F.lit(False) if self.most is None else value > F.lit(self.most)
        return F.coalesce(low | high, F.lit(False))


#: The first two are the base rules; ratios are compared as products so that no text divides by zero.
RULES = (
    Rule("few_words", "n_words", least=20),
    Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", most=0),
    Rule("word_length_low", "word_chars - 2 * n_words", least=0),
    Rule("word_length_high", "word_chars - 15 * n_words", most=0),
    Rule("symbols", "100 * n_symbols - 10 * n_words", most=0),
    Rule("duplicate_lines", "100 * n_dup_lines - 30 * n_lines", most=0),
    Rule("stop_words", "100 * n_stop_words - n_words", least=0),
    Rule("exclamations", "100 * n_exclamations - 30 * n_words", most=0),
)
BASE = RULES[:2]


def _lengths(text: Column, dropped: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, dropped, ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measures of each text; a null text is an empty one.

    n_repeat_words counts the words inside 8-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hashes inside one text: a text of n words has a false match
    with a chance under n * n / 2**65. Only texts with an equal pair sort their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"_text": text, "_words": word_list(F.col("text")), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    n = F.size("_words")
    hashes = F.when(n < WINDOW, F.expr("CAST(array() AS array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW)))))
    out = out.withColumn("_hashes", hashes)
    sort = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), sort).otherwise(F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)")))
    twin = F.filter("_sorted", lambda s, k: F.coalesce(F.get("_sorted", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == s["h"], F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twin, lambda s: s["i"])))
    # every window covers its 8 words, less those that the next one covers again
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": _lengths(F.col("_text"), SYMBOLS),
            "n_exclamations": _lengths(F.col("_text"), "!"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_hashes", "_sorted", "_at")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus measures, ``failed_rules``, ``base_failed`` and ``kept``.

    Columns of ``docs`` with the name of a measure or verdict are replaced. A null or empty text
    has zero words and fails. Repeated rows are judged alike.
    """
    failed = F.filter(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    base = F.lit(False)
    for r in BASE:
        base = base | r.failed()
    out = measured(docs).withColumns({"failed_rules": failed, "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def passed(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; null and empty texts are rejected.

    A filter on ``kept`` alone would be pushed below the measures, which copies their expressions into
    each other once for each use. A random column, which no filter passes, holds it where it is.
    """
    verdicts = judged(docs.withColumn("_row", F.struct(*docs.columns)), rules).select("_row", "kept").withColumn("_hold", F.rand(0))
    return verdicts.filter("kept AND _hold >= 0").select("_row.*")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7_rules(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir).select("doc_id", "text")).select(*COLUMNS)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def measures_sql(table: str) -> str:
    """DuckDB common table expressions up to ``verdicts``, over ``table`` (doc_id, text)."""
    checks = {r.name: " OR ".join(f"{r.measure} {op} {x}" for op, x in (("<", r.least), (">", r.most)) if x is not None) for r in RULES}
    return f"""texts AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM split, range(1, len(words) - {WINDOW - 2}) AS r(i) WHERE len(words) >= {WINDOW}),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
measures AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)),
verdicts AS (SELECT *, ({' OR '.join(checks[r.name] for r in BASE)}) AS base_failed, NOT ({' OR '.join(checks.values())}) AS kept FROM measures)"""


OP7_SQL = f"WITH {measures_sql('documents')} SELECT {', '.join(COLUMNS)} FROM verdicts"
