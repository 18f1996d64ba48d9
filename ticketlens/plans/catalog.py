"""The registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.functions import dates as D
from ticketlens.operators import cluster as C
from ticketlens.operators import executive as X
from ticketlens.operators import families as M
from ticketlens.operators import origin as O
from ticketlens.operators import overview as V
from ticketlens.operators import problems as P
from ticketlens.operators import profile as R
from ticketlens.operators import trends as T
from ticketlens.operators import weekly as W
from ticketlens.operators.search import SearchIndex
from ticketlens.operators.weekstate import WeekState
from ticketlens.plans.filters import Filters, Selection, by_months, dimension_options, filtered, options, searched, with_label
from ticketlens.plans.ingested import TEXTS, ingested, ingested_kinds
from ticketlens.plans.oracle import known_sql, pct_sql, q, round1_sql, sql, tokens_sql, truncate_sql, whole_pct_sql
from ticketlens.plans.shared import checkpoint, scratch, small_batches, stored
from ticketlens.sources import sinks as S
from ticketlens.sources.view import incidents, tickets

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
KEY = "category"


_TABLES: dict[tuple, DataFrame] = {}


def _state(spark, sf_dir: str) -> tuple:
    """Path, length and time of every file that the view reads."""
    jvm, found = spark.sparkContext._jvm, []
    for table in ("documents", "events", "orders", "labels", "conversations"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def ticket_table(spark, sf_dir: str) -> DataFrame:
    """Annotated tickets as a Parquet table, written once for an application and state of the input's files.

    Notes, scores and causes are then worked out once, and a query reads its own columns only.
    """
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if key not in _TABLES:
        with small_batches(spark):
            _TABLES[key] = stored(tickets(spark, sf_dir))
    return _TABLES[key]


#: What families' queries read of a ticket.
FAMILY_COLUMNS = ("row_id", "number", "short_desc_clean", "desc_clean", "opened", "week", "month", "assignment_group", "service", "service_offering")


def family_table(spark, sf_dir: str) -> DataFrame:
    """The tickets' columns that families need: the whole table's where it is there, else a narrow one, written once as that one is."""
    state = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if state in _TABLES:
        return _TABLES[state].select(*FAMILY_COLUMNS)
    key = ("families", *state)
    if key not in _TABLES:
        with small_batches(spark):
            _TABLES[key] = stored(tickets(spark, sf_dir).select(*FAMILY_COLUMNS), "zstd")
    return _TABLES[key]


def query(name: str, statement: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(ticket_table(spark, sf_dir))
    if statement is not None:
        SQL[name] = statement


def score_dims_sql(f: str) -> str:
    return ", ".join(f"{f.format(d)} AS avg_{d}" for d in config.DIMS)


MEAN1 = "coalesce(" + round1_sql("avg({0})") + ", 0.0)"
LABEL_COUNTS = ", ".join(f"count(*) FILTER (label = '{x}') AS n_{x.lower()}" for x in config.LABELS)
TRACKED, MISSED = "count(*) FILTER (is_closed AND made_sla IS NOT NULL)", "count(*) FILTER (is_closed AND NOT made_sla)"
BREACH1 = f"CASE WHEN {TRACKED} > 0 THEN {pct_sql(MISSED, TRACKED)} END"
BREACH0 = f"CASE WHEN {TRACKED} > 0 THEN {whole_pct_sql(MISSED, TRACKED)} END"
DOCUMENTED = "count(*) FILTER (root_cause_text <> '')"

# --- rows -----------------------------------------------------------------------------------
QUERIES["incidents"] = lambda spark, sf_dir: incidents(spark, sf_dir)
SQL["incidents"] = sql("SELECT * FROM incidents")
# the same tickets after a way through CSV files, encodings, header aliases, date and flag texts, typed columns
QUERIES["ingested_tickets"] = ingested
SQL["ingested_tickets"] = sql(f"SELECT {', '.join(TEXTS)}, opened, closed, made_sla, nullif(service, '') AS service, nullif(service_offering, '') AS service_offering, CAST(NULL AS VARCHAR) AS resolution_code, substring(opened, 1, 10) AS due, row_id * 3 + CAST(0.25 AS DOUBLE) AS cost, CAST(row_id AS VARCHAR) AS order_id FROM incidents")
QUERIES["ingested_kinds"] = ingested_kinds
SQL["ingested_kinds"] = "SELECT export, column_name, kind FROM (VALUES ('display'), ('field')) AS e(export), (VALUES ('Due', 'date'), ('Cost', 'number'), ('Order ID', 'text')) AS k(column_name, kind) UNION ALL SELECT export, CASE WHEN export = 'display' THEN s ELSE f END, 'text' FROM (VALUES ('display'), ('field')) AS e(export), (VALUES ('Service', 'business_service'), ('Service offering', 'service_offering')) AS d(s, f)"
query("enriched", sql("SELECT row_id, number, short_desc_clean, desc_clean, is_auto_desc, CAST(len(texts) AS INTEGER) AS human_notes FROM enriched"), lambda t: t.select("row_id", "number", "short_desc_clean", "desc_clean", "is_auto_desc", F.size("human_notes").alias("human_notes")))
query("journal_notes", sql("SELECT row_id, CAST(pos - 1 AS INTEGER) AS pos, noted_at, author, note, is_system FROM notes"), lambda t: t.select("row_id", F.posexplode("all_notes").alias("pos", "x")).select("row_id", "pos", F.col("x.timestamp").alias("noted_at"), F.col("x.author").alias("author"), F.col("x.text").alias("note"), F.col("x.is_system").alias("is_system")))
query("scores", sql(f"SELECT row_id, total, label, {', '.join(config.DIMS)}, round(noise_ratio, 6) AS noise_ratio, CAST(note_count AS INTEGER) AS note_count, CAST(note_chars AS INTEGER) AS note_chars, array_to_string(feedback, ' / ') AS feedback FROM annotated"), lambda t: t.select("row_id", "score.total", "score.label", "score.dims.*", F.round("score.noise_ratio", 6).alias("noise_ratio"), "score.note_count", "score.note_chars", F.array_join("score.feedback", " / ").alias("feedback")))
query("annotated", sql("SELECT row_id, category, root_cause_text, round(resolution_hours, 6) AS resolution_hours, week, month, is_closed, array_to_string(list_sort(tokens), ' ') AS tokens, service, service_offering FROM annotated"), lambda t: t.select("row_id", "category", "root_cause_text", F.round("resolution_hours", 6).alias("resolution_hours"), "week", "month", "is_closed", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), "service", "service_offering"))
query("token_counts", sql("SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM annotated) GROUP BY token"), C.token_counts)
query("period_labels", sql("""SELECT DISTINCT week, concat('W', substring(week, 7, 2), ' · ', CAST(extract(day FROM d) AS VARCHAR), ' ', strftime(d, '%b')) AS week_label, concat(CAST(extract(day FROM d) AS VARCHAR), ' ', strftime(d, '%b'), ' – ', CAST(extract(day FROM d + 6) AS VARCHAR), ' ', strftime(d + 6, '%b %Y')) AS week_range, month, strftime(CAST(concat(month, '-01') AS DATE), '%b %Y') AS month_label
FROM (SELECT week, month, CAST(date_trunc('week', CAST(opened AS TIMESTAMP)) AS DATE) AS d FROM annotated)"""), lambda t: t.select("week", D.week_label(F.col("week")).alias("week_label"), D.week_range_label(F.col("week")).alias("week_range"), "month", D.month_label(F.col("month")).alias("month_label")).distinct())

# --- overview -------------------------------------------------------------------------------
query("overview", sql(f"""SELECT count(*) AS total, {MEAN1.format('total')} AS avg_score, {LABEL_COUNTS}, count(*) FILTER (root_cause = 0) AS no_root_cause, count(*) FILTER (noise_ratio > 0.5) AS high_noise,
 count(*) FILTER (is_auto_desc) AS auto_generated, count(*) FILTER (note_count = 0) AS empty_notes, CAST(floor(avg(note_chars) + 0.5) AS BIGINT) AS avg_note_chars, CAST(floor(median(note_chars) + 0.5) AS BIGINT) AS median_note_chars,
 {MEAN1.format('note_count')} AS avg_note_count, {pct_sql('count(*) FILTER (note_count > 0)', 'count(*)')} AS has_human_notes_pct FROM annotated"""), V.overview)
query("operational", sql(f"""SELECT round(median(resolution_hours), 6) AS median_hours, count(resolution_hours) AS resolved, {BREACH0} AS sla_breach_pct, count(*) FILTER (NOT is_closed) AS open_count,
 {whole_pct_sql('(SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM annotated GROUP BY category) WHERE k >= 2)', 'count(*)')} AS recurring_pct FROM annotated"""), lambda t: V.operational(t, KEY))
_LONG = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value FROM annotated" for d in config.DIMS)
query("dim_stats", sql(f"""SELECT dimension, {MEAN1.format('value')} AS avg, {pct_sql('count(*) FILTER (value = 0)', 'count(*)')} AS zero_pct, {pct_sql('count(*) FILTER (value = 100)', 'count(*)')} AS full_pct,
 count(*) FILTER (value < 25) AS below_25, count(*) FILTER (value >= 25 AND value < 50) AS below_50, count(*) FILTER (value >= 50 AND value < 75) AS below_75, count(*) FILTER (value >= 75) AS from_75 FROM long GROUP BY dimension""", f"long AS ({_LONG})"), V.dim_stats)
query("feedback", sql(f"SELECT message, count(*) AS n, {pct_sql('count(*)', '(SELECT count(*) FROM annotated)')} AS pct FROM (SELECT unnest(feedback) AS message FROM annotated) GROUP BY message"), V.feedback_counts)
query("agent_stats", sql(f"SELECT coalesce(nullif(assigned_to, ''), 'Unassigned') AS agent, count(*) AS n, {MEAN1.format('total')} AS avg_score, {LABEL_COUNTS} FROM annotated GROUP BY 1 HAVING count(*) >= 2"), V.agent_stats)
query("agents_by_label", sql(f"SELECT * FROM (SELECT coalesce(nullif(assigned_to, ''), 'Unassigned') AS agent, count(*) AS n, {MEAN1.format('total')} AS avg_score, {LABEL_COUNTS} FROM annotated GROUP BY 1 HAVING count(*) >= 2) WHERE n_good > 0"), lambda t: V.agents_with_label(V.agent_stats(t), "Good"))
_GROUPS = f"""SELECT coalesce(nullif(assignment_group, ''), 'Unassigned') AS grp, count(*) AS n, {MEAN1.format('total')} AS avg_score, count(*) FILTER (label = 'Excellent') AS n_excellent, count(*) FILTER (label = 'Critical') AS n_critical,
 CAST(floor(avg(noise_ratio) * 100 + 0.5) AS BIGINT) AS noise_pct, {MEAN1.format('root_cause')} AS avg_root_cause, CAST(floor(avg(note_chars) + 0.5) AS BIGINT) AS avg_note_chars FROM annotated GROUP BY 1"""
query("group_stats", sql(_GROUPS), V.group_stats)
query("root_cause_by_group", sql(f"SELECT grp, n, avg_root_cause FROM ({_GROUPS}) WHERE n >= 3 ORDER BY avg_root_cause DESC, grp LIMIT 15"), V.root_cause_by_group)


def buckets_sql(value: str, names: tuple[str, ...], below: tuple[float, ...]) -> str:
    which = "CASE " + " ".join(f"WHEN {value} < {b} THEN {i}" for i, b in enumerate(below)) + f" ELSE {len(below)} END"
    axis = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(names))
    return sql(f"SELECT bucket, coalesce(k, 0) AS n FROM (VALUES {axis}) AS a(i, bucket) LEFT JOIN (SELECT {which} AS b, count(*) AS k FROM annotated GROUP BY 1) ON b = i")


query("note_length_buckets", buckets_sql("note_chars", ("0", "1-50", "51-200", "201-500", "501+"), (1, 51, 201, 501)), V.note_length_buckets)
query("short_description_buckets", buckets_sql("length(short_desc_clean)", ("0", "1-24", "25-60", "61+"), (1, 25, 61)), V.short_description_buckets)
query("noise_buckets", buckets_sql("noise_ratio", ("0-20%", "20-50%", "50-80%", "80-100%"), (0.2, 0.5, 0.8)), V.noise_buckets)
for _c in ("state", "priority"):
    query(f"{_c}_distribution", sql(f"SELECT coalesce(nullif({_c}, ''), 'Unknown') AS value, count(*) AS n FROM annotated GROUP BY 1"), lambda t, c=_c: V.distribution(t, c))
query("note_length_by_label", sql(f"SELECT l.label, coalesce(m, 0) AS avg_note_chars FROM (VALUES {', '.join(f'({q(x)})' for x in config.LABELS)}) AS l(label) LEFT JOIN (SELECT label, CAST(floor(avg(note_chars) + 0.5) AS BIGINT) AS m FROM annotated GROUP BY label) a ON a.label = l.label"), V.note_length_by_label)
_KPI = "count(*) AS n, count(*) FILTER (root_cause = 0) AS rc, count(*) FILTER (label IN ('Poor', 'Critical')) AS pc, count(*) FILTER (noise_ratio > 0.5) AS hn, " + MEAN1.format("total") + " AS av"
query("insights", sql(f"""SELECT 'warning' AS kind, 'no_root_cause_pct' AS metric, {pct_sql('rc', 'n')} AS value FROM k WHERE rc / n > 0.3
UNION ALL SELECT 'warning', 'poor_or_critical_pct', {pct_sql('pc', 'n')} FROM k WHERE pc / n > 0.2 UNION ALL SELECT 'warning', 'high_noise_pct', {pct_sql('hn', 'n')} FROM k WHERE hn / n > 0.15
UNION ALL SELECT 'info', concat('weakest:', dimension), a FROM (SELECT dimension, {MEAN1.format('value')} AS a FROM long GROUP BY dimension ORDER BY a, dimension LIMIT 1)
UNION ALL SELECT CASE WHEN av < 60 THEN 'warning' ELSE 'positive' END, CASE WHEN av < 60 THEN 'low_average' ELSE 'high_average' END, av FROM k WHERE av < 60 OR av >= 75""", f"long AS ({_LONG})", f"k AS (SELECT {_KPI} FROM annotated)"), V.insights)

# --- trends ---------------------------------------------------------------------------------


def trends_sql(period: str) -> str:
    n = "count(*)"
    return f"""SELECT {period} AS period, {n} AS n, {MEAN1.format('total')} AS avg_score, {score_dims_sql(MEAN1)}, {whole_pct_sql("count(*) FILTER (label = 'Excellent')", n)} AS excellent_pct,
 {whole_pct_sql("count(*) FILTER (label IN ('Poor', 'Critical'))", n)} AS poor_pct, {whole_pct_sql('count(*) FILTER (root_cause = 0)', n)} AS no_root_cause_pct, {whole_pct_sql('count(*) FILTER (noise_ratio > 0.5)', n)} AS noise_pct,
 {round1_sql('median(resolution_hours)')} AS median_hours, {BREACH0} AS sla_breach_pct, {whole_pct_sql(DOCUMENTED, n)} AS rca_pct, count(*) FILTER (NOT is_closed) AS open_count FROM annotated WHERE {period} <> '' GROUP BY 1"""


for _p in ("week", "month"):
    query(f"trends_by_{_p}", sql(trends_sql(_p)), lambda t, p=_p: T.period_trends(t, p))
query("trend_deltas", sql("""SELECT min(period) AS first_period, max(period) AS last_period, round(arg_max(avg_score, period) - arg_min(avg_score, period), 6) AS avg_score_delta, round(arg_max(avg_root_cause, period) - arg_min(avg_root_cause, period), 6) AS avg_root_cause_delta,
 arg_max(noise_pct, period) - arg_min(noise_pct, period) AS noise_pct_delta FROM tr HAVING count(*) >= 2""", f"tr AS ({trends_sql('month')})"), lambda t: T.trend_deltas(T.period_trends(t, "month")))
query("trend_previous", sql("""SELECT period, n, lag(period) OVER w AS previous, round(avg_score - lag(avg_score) OVER w, 6) AS score_delta, sla_breach_pct - lag(sla_breach_pct) OVER w AS sla_delta FROM tr WINDOW w AS (ORDER BY period)""", f"tr AS ({trends_sql('week')})"), lambda t: T.with_previous(T.period_trends(t)))
query("trend_history", sql("SELECT * FROM tr WHERE period <= '2024-W10' ORDER BY period DESC LIMIT 12", f"tr AS ({trends_sql('week')})"), lambda t: T.history(T.period_trends(t), "2024-W10"))

# --- problems, by category as key ------------------------------------------------------------
_CAUSES = """keyed AS (SELECT category, row_id, root_cause_text, CASE WHEN ck = '' THEN lower(root_cause_text) ELSE ck END AS cause_key FROM (SELECT *, array_to_string(list_sort({tok}), ' ') AS ck FROM annotated WHERE root_cause_text <> '')),
causes AS (SELECT category, cause_key, arg_min(root_cause_text, row_id) AS cause, count(*) AS n, min(row_id) AS first_row FROM keyed GROUP BY 1, 2),
top_causes AS (SELECT category, rank, cause, n, {pct} AS pct FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first_row) AS rank, (SELECT count(*) FROM annotated a WHERE a.category = causes.category) AS k FROM causes) WHERE rank <= 5)"""
CAUSES = _CAUSES.replace("{tok}", tokens_sql("root_cause_text")).replace("{pct}", pct_sql("n", "k"))
TABLE = f"""top_name AS (SELECT category AS c, name FROM (SELECT category, short_desc_clean AS name, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, short_desc_clean COLLATE en, short_desc_clean) AS r FROM annotated WHERE short_desc_clean <> '' GROUP BY 1, 2) WHERE r = 1),
flat AS (SELECT category, count(*) AS n, count(DISTINCT nullif(week, '')) AS weeks_active, coalesce(min(nullif(opened, '')), '') AS first_seen, coalesce(max(nullif(opened, '')), '') AS last_seen, {DOCUMENTED} AS documented, {pct_sql(DOCUMENTED, 'count(*)')} AS rca_coverage,
 median(resolution_hours) AS median_hours, {BREACH1} AS sla_breach_pct, {MEAN1.format('total')} AS avg_score, {pct_sql('count(*)', '(SELECT count(*) FROM annotated)')} AS share, count(DISTINCT nullif(week, '')) >= 3 AND count(*) >= 3 AS is_chronic FROM annotated GROUP BY category HAVING count(*) >= 2),
problem_table AS (SELECT flat.*, {truncate_sql("coalesce(name, '(no short description)')", 110)} AS title FROM flat LEFT JOIN top_name ON c = category)"""
query("problem_table", sql("SELECT category, n, weeks_active, first_seen, last_seen, documented, rca_coverage, round(median_hours, 6) AS median_hours, sla_breach_pct, avg_score, title, share, is_chronic FROM problem_table", TABLE), lambda t: P.problem_table(t, KEY).withColumn("median_hours", F.round("median_hours", 6)))
query("problem_causes", sql("SELECT category, CAST(rank AS INTEGER) AS rank, cause, n, pct FROM top_causes", CAUSES), lambda t: P.top_causes(t, KEY))
for _n, _col in (("groups", "assignment_group"), ("agents", "assigned_to")):
    query(f"problem_{_n}", sql(f"SELECT category, name, n, CAST(rank AS INTEGER) AS rank FROM (SELECT category, coalesce(nullif({_col}, ''), 'Unassigned') AS name, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, name COLLATE en, name) AS rank FROM annotated GROUP BY 1, 2) WHERE rank <= 3"), lambda t, c=_col: P.top_counts(t, KEY, V._or(c, "Unassigned"), 3))
query("problem_samples", sql("SELECT category, CAST(rank AS INTEGER) AS rank, number FROM (SELECT category, number, row_number() OVER (PARTITION BY category ORDER BY row_id) AS rank FROM annotated) WHERE rank <= 25"), lambda t: P.sample_numbers(t, KEY))
query("category_stats", sql(f"SELECT category, count(*) AS n, count(DISTINCT week) AS distinct_problems, {pct_sql(DOCUMENTED, 'count(*)')} AS rca_coverage, round(median(resolution_hours), 6) AS median_hours, {BREACH1} AS sla_breach_pct, {MEAN1.format('total')} AS avg_score, {pct_sql('count(*)', '(SELECT count(*) FROM annotated)')} AS share FROM annotated GROUP BY category"), lambda t: P.category_stats(t, "week"))
query("recommend", sql("""SELECT category, kind, n, CAST(CASE kind WHEN 'problem-management' THEN 0 WHEN 'chronic' THEN 1 WHEN 'automation' THEN 2 ELSE 3 END AS INTEGER) AS priority FROM (SELECT p.category, p.n,
 CASE WHEN rca_coverage < 50 THEN 'problem-management' WHEN median_hours <= 2 THEN 'automation' WHEN k >= 3 AND top < 40 THEN 'knowledge-gap' WHEN is_chronic THEN 'chronic' END AS kind FROM problem_table p
 LEFT JOIN (SELECT category, count(*) AS k, arg_min(pct, rank) AS top FROM top_causes GROUP BY 1) c ON c.category = p.category WHERE p.n >= greatest(3, floor((SELECT count(*) FROM annotated) * 0.01 + 0.5))) WHERE kind IS NOT NULL""", TABLE, CAUSES), lambda t: P.recommend(t, KEY))
query("problem_totals", sql(f"""SELECT count(*) AS distinct_problems, CAST(sum(n) AS BIGINT) AS recurring, count(*) FILTER (is_chronic) AS chronic, {pct_sql('sum(documented)', 'sum(n)')} AS documented_pct,
 {pct_sql('(SELECT sum(n) FROM (SELECT n FROM problem_table ORDER BY n DESC, title COLLATE en LIMIT 10))', 'sum(n)')} AS top10_pct FROM problem_table""", TABLE), lambda t: P.problem_totals(P.problem_table(t, KEY)))
query("visible_problems", sql("SELECT category, n, rca_coverage FROM problem_table WHERE rca_coverage < 50 AND (contains(lower(title), 'o') OR contains(lower(category), 'o'))", TABLE), lambda t: P.visible(P.problem_table(t, KEY), undocumented=True, search=" O ").select("category", "n", "rca_coverage"))
query("problem_sheet", sql("""SELECT p.category, title, n, rca_coverage, coalesce(rc, '') AS root_causes, tg AS top_groups, sn AS sample_numbers FROM problem_table p
 LEFT JOIN (SELECT category, string_agg(concat(CAST(rank AS VARCHAR), '. ', cause, ' (', CAST(n AS VARCHAR), ')'), chr(10) ORDER BY rank) AS rc FROM top_causes WHERE rank <= 3 GROUP BY 1) c ON c.category = p.category
 LEFT JOIN (SELECT category, string_agg(concat(name, ' (', CAST(n AS VARCHAR), ')'), '; ' ORDER BY rank) AS tg FROM (SELECT category, coalesce(nullif(assignment_group, ''), 'Unassigned') AS name, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, name COLLATE en, name) AS rank FROM annotated GROUP BY 1, 2) WHERE rank <= 3 GROUP BY 1) g ON g.category = p.category
 LEFT JOIN (SELECT category, string_agg(number, ', ' ORDER BY row_id) AS sn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS r FROM annotated) WHERE r <= 25 GROUP BY 1) s ON s.category = p.category""", TABLE, CAUSES), lambda t: S.problem_sheet(t, KEY).select(KEY, "title", "n", "rca_coverage", "root_causes", "top_groups", "sample_numbers"))
def fit_sql(c: str) -> str:
    mark = f"concat(chr(10), '…[TRUNCADO: el valor original tiene ', length({c}), ' caracteres; Excel admite {config.CELL_LIMIT}]')"
    return f"CASE WHEN length({c}) > {config.CELL_LIMIT} THEN concat(substring({c}, 1, {config.CELL_LIMIT} - length({mark})), {mark}) ELSE nullif({c}, '') END"


def serial_sql(c: str) -> str:
    return f"(CAST(epoch(CAST(nullif({c}, '') AS TIMESTAMP)) AS BIGINT) + 2209161600) / CAST(86400 AS DOUBLE)"


def _detail(t: DataFrame) -> DataFrame:
    """With two columns that a file might have besides: a date and an amount, as text.

    The statement names two columns root_cause; as a table's column the second, the cause as written, is root_cause_1.
    """
    wide = t.withColumns({"due": F.substring("opened", 1, 10), "size": F.concat(F.col("row_id").cast("string"), F.lit(".25"))})
    return S.detail_sheet(wide, P.problem_table(t, KEY), KEY, {"due": "date", "size": "number"}).withColumnRenamed("root_cause_text", "root_cause_1")


_WHOLE = ", ".join(f"{fit_sql('a.' + c)} AS {c}" for c in ("number", "task_type", "priority", "state", "short_description", "description", "work_notes", "assignment_group", "assigned_to", "channel"))
_NONE = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}_text" for c in ("opened", "closed", "due", "size"))
query("detail_sheet", sql(f"SELECT a.category, title AS problem, {_WHOLE}, {serial_sql('opened')} AS opened, {serial_sql('closed')} AS closed, {serial_sql('substring(opened, 1, 10)')} AS due, row_id + CAST(0.25 AS DOUBLE) AS size, {_NONE}, made_sla, week, round(resolution_hours, 6) AS resolution_hours, is_closed, total AS score, label, {', '.join(config.DIMS)}, root_cause_text AS root_cause FROM annotated a JOIN problem_table p ON p.category = a.category", TABLE), _detail)
query("typed_cells", sql("SELECT row_id, strftime(CAST(opened AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS opened_at, CASE WHEN closed <> '' THEN strftime(CAST(closed AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS closed_at, row_id + CAST(0.5 AS DOUBLE) AS as_number, CAST(NULL AS DOUBLE) AS not_a_number FROM annotated"), lambda t: t.select("row_id", F.date_format(S.as_date(F.col("opened")), "yyyy-MM-dd HH:mm:ss").alias("opened_at"), F.date_format(S.as_date(F.col("closed")), "yyyy-MM-dd HH:mm:ss").alias("closed_at"), S.as_number(F.concat(F.col("row_id").cast("string"), F.lit(".5"))).alias("as_number"), S.as_number(F.col("number")).alias("not_a_number")))
query("metadata_sheet", sql("""SELECT unnest(['filters', 'opened_from', 'opened_to', 'tickets', 'problems', 'scorer_version', 'truncated_cells']) AS field, unnest(['all', (SELECT min(nullif(opened, '')) FROM annotated), (SELECT max(opened) FROM annotated), (SELECT CAST(count(*) AS VARCHAR) FROM annotated), (SELECT CAST(count(*) AS VARCHAR) FROM problem_table), '1',
 (SELECT CAST(count(*) FILTER (length(work_notes) > 32767) AS VARCHAR) FROM annotated)]) AS value""", TABLE), lambda t: S.metadata_sheet(t.select("opened", "work_notes", "row_id"), P.problem_table(t, KEY), "all"))

# --- filters and lists ------------------------------------------------------------------------
FILTERS = Filters(months=("2024-01", "2024-02"), service=Selection(("en", "de"), missing=True), service_offering=Selection(("offering_1", "offering_2", "offering_3")))
_MONTHS, _SERVICE, _OFFER = "month IN ('2024-01', '2024-02')", "(service IN ('en', 'de') OR service IS NULL)", "service_offering IN ('offering_1', 'offering_2', 'offering_3')"
query("filter_months", sql("SELECT row_id, month FROM annotated WHERE month IN ('2024-02')"), lambda t: by_months(t, ["2024-02"]).select("row_id", "month"))
query("filter_global", sql(f"SELECT row_id, service, service_offering, month FROM annotated WHERE {_MONTHS} AND {_SERVICE} AND {_OFFER}"), lambda t: filtered(t, FILTERS).select("row_id", "service", "service_offering", "month"))
query("filtered_overview", sql(f"SELECT count(*) AS total, {MEAN1.format('total')} AS avg_score, {LABEL_COUNTS} FROM annotated WHERE {_MONTHS} AND {_SERVICE} AND {_OFFER}"), lambda t: V.overview(filtered(t, FILTERS)).select("total", "avg_score", *[f"n_{x.lower()}" for x in config.LABELS]))
query("ticket_search", sql("SELECT row_id, number FROM annotated WHERE (contains(lower(number), 'vpn') OR contains(lower(assigned_to), 'vpn') OR contains(lower(short_description), 'vpn') OR contains(lower(assignment_group), 'vpn')) AND state = 'Closed'"), lambda t: searched(t, "VPN", state="Closed").select("row_id", "number"))
query("ticket_search_indexed", SQL["ticket_search"], lambda t: SearchIndex.build(t.select("row_id", "number", "assigned_to", "short_description", "assignment_group", "state"), scratch(t.sparkSession, "index")).search("VPN", state="Closed").select("row_id", "number"))
query("quality_view", sql("SELECT row_id FROM annotated WHERE label = 'Good'"), lambda t: with_label(t, "Good").select("row_id"))
query("option_lists", sql("SELECT DISTINCT assignment_group AS value FROM annotated WHERE assignment_group <> ''"), lambda t: options(t, "assignment_group"))
query("dimension_options", sql("SELECT DISTINCT service AS value, (SELECT bool_or(service IS NULL) FROM annotated) AS has_missing FROM annotated WHERE service IS NOT NULL"), lambda t: dimension_options(t, "service"))

# --- origin ------------------------------------------------------------------------------------
DIM = f"d AS (SELECT *, {known_sql('assignment_group')} AS grp, service AS svc, service_offering AS off FROM annotated)"
_COL = {"group": "grp", "service": "svc", "offering": "off"}
_CAND = "count(DISTINCT category) FILTER (category IN (SELECT category FROM annotated GROUP BY 1 HAVING count(*) >= 2))"


def dimension_sql(d: str) -> str:
    return f"SELECT {_COL[d]} AS value, count(*) AS n, count(DISTINCT grp) AS distinct_groups, count(DISTINCT svc) AS distinct_services, count(DISTINCT off) AS distinct_offerings, {_CAND} AS candidates, round(count(*) / (SELECT count(*) FROM annotated), 6) AS share FROM d GROUP BY 1"


for _d in _COL:
    query(f"dimension_{_d}", sql(dimension_sql(_d), DIM), lambda t, d=_d: O.dimension_table(t, d, KEY))
query("dimension_coverage", sql("SELECT count(*) AS visible, count(service) AS with_value, round(count(service) / count(*), 6) AS coverage FROM annotated"), lambda t: O.coverage(t, "service"))
query("dimension_search", sql(f"SELECT * FROM ({dimension_sql('group')}) WHERE contains(lower(value), 'src1')", DIM), lambda t: O.table_search(O.dimension_table(t, "group", KEY), "SRC1"))
query("dimension_page", sql("SELECT value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT grp AS value, count(*) AS n, row_number() OVER (ORDER BY grp IS NULL, count(*) DESC, grp COLLATE en, grp) AS rank FROM d GROUP BY 1) WHERE rank BETWEEN 6 AND 10", DIM), lambda t: O.page(O.dimension_table(t, "group", KEY), 1, 5).select("value", "n", "rank"))
query("cross_tab", sql("SELECT CAST(grouping(svc, grp) AS INTEGER) AS level, svc AS row_value, grp AS column_value, count(*) AS n FROM d GROUP BY GROUPING SETS ((svc, grp), (svc), (grp), ())", DIM), lambda t: O.cross_tab(t, "service", "group"))
query("pair_table", sql(f"SELECT svc AS left_value, off AS right_value, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share, count(DISTINCT grp) AS distinct_groups, {_CAND} AS candidates, svc IS NULL OR off IS NULL AS is_partial FROM d GROUP BY 1, 2", DIM), lambda t: O.pair_table(t, "service", "offering", KEY))
query("monthly_series", sql("SELECT v.svc AS value, m.month, count(d.row_id) AS n, (SELECT count(*) FROM d x WHERE x.month = m.month) AS month_total, round(count(d.row_id) / (SELECT count(*) FROM d x WHERE x.month = m.month), 6) AS share FROM (SELECT DISTINCT svc FROM d) v CROSS JOIN (SELECT DISTINCT month FROM d) m LEFT JOIN d ON d.svc IS NOT DISTINCT FROM v.svc AND d.month = m.month GROUP BY 1, 2", DIM), lambda t: O.monthly_series(t, "service"))
query("facets", sql(f"SELECT service AS value, count(*) AS n FROM annotated WHERE {_MONTHS} AND {_OFFER} GROUP BY 1"), lambda t: O.facets(t, FILTERS, "service"))
query("facets_all", sql(f"""SELECT 'month' AS dimension, month AS value, count(*) AS n FROM annotated WHERE {_SERVICE} AND {_OFFER} GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM annotated WHERE {_MONTHS} AND {_OFFER} GROUP BY 2
 UNION ALL SELECT 'service_offering', service_offering, count(*) FROM annotated WHERE {_MONTHS} AND {_SERVICE} GROUP BY 2"""), lambda t: O.all_facets(t, FILTERS))
query("facets_offering", sql(f"SELECT service_offering AS value, count(*) AS n FROM annotated WHERE {_MONTHS} AND {_SERVICE} GROUP BY 1"), lambda t: O.facets(t, FILTERS, "service_offering"))
query("cluster_members", sql(f"SELECT category, count(*) AS visible_count, (SELECT count(*) FROM annotated b WHERE b.category = a.category) AS total_count FROM annotated a WHERE {_MONTHS} GROUP BY 1"), lambda t: O.members(t, filtered(t, Filters(FILTERS.months)), KEY))
query("candidate_context", sql(f"""SELECT c.category, c.visible_count, c.known_service, c.missing_service, c.distinct_services, c.missing_offering, c.distinct_groups, (SELECT count(*) FROM annotated b WHERE b.category = c.category) AS total_count, top_services, top_count,
 CASE WHEN l.k IS NULL THEN 'NO_KNOWN_SERVICE' WHEN l.k > 1 THEN 'TIE' ELSE 'SINGLE' END AS top_state, round(top_count / known_service, 6) AS top_share
 FROM (SELECT category, count(*) AS visible_count, count(svc) AS known_service, count(*) FILTER (svc IS NULL) AS missing_service, count(DISTINCT svc) AS distinct_services, count(*) FILTER (off IS NULL) AS missing_offering, count(DISTINCT grp) AS distinct_groups FROM d WHERE {_MONTHS} GROUP BY 1) c
 LEFT JOIN (SELECT category, string_agg(svc, ',' ORDER BY svc) AS top_services, max(n) AS top_count, count(*) AS k FROM (SELECT category, svc, count(*) AS n, rank() OVER (PARTITION BY category ORDER BY count(*) DESC) AS r FROM d WHERE {_MONTHS} AND svc IS NOT NULL GROUP BY 1, 2) WHERE r = 1 GROUP BY 1) l ON l.category = c.category""", DIM), lambda t: O.candidate_context(t, filtered(t, Filters(FILTERS.months)), KEY))
_TOP = """r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value COLLATE en, value) AS rank FROM (SELECT {0} AS value, count(*) AS n FROM d GROUP BY 1) WHERE value IS NOT NULL)"""
query("top_with_others", sql("SELECT CASE WHEN rank <= 5 THEN 'top' ELSE 'others' END AS segment, CASE WHEN rank <= 5 THEN value END AS value, count(*) AS entries, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT 'missing', NULL, 1, k FROM (SELECT count(*) AS k FROM d WHERE off IS NULL) WHERE k > 0", DIM, _TOP.format("off")), lambda t: O.top_with_others(O.dimension_table(t, "offering", KEY), 5))
query("service_ranking", sql("SELECT CAST(least(rank, 3) AS INTEGER) AS place, CASE WHEN rank <= 2 THEN 'service' ELSE 'others' END AS kind, CASE WHEN rank <= 2 THEN value END AS value, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT count(*) FROM d), 6) AS share FROM r GROUP BY 1, 2, 3 UNION ALL SELECT 4, 'missing', NULL, k, round(k / (SELECT count(*) FROM d), 6) FROM (SELECT count(*) AS k FROM d WHERE svc IS NULL) WHERE k > 0", DIM, _TOP.format("svc")), lambda t: O.service_ranking(t, KEY, 2))
query("cross_tab_row", sql("SELECT grp AS value, count(*) AS n FROM d WHERE svc = 'en' GROUP BY 1", DIM), lambda t: O.expanded_row(t, "service", "group", "en"))
query("capped_matrix", sql("""SELECT CASE WHEN grp IS NULL THEN '(none)' ELSE coalesce(a.value, 'Others') END AS row_value, CASE WHEN off IS NULL THEN '(none)' ELSE coalesce(b.value, 'Others') END AS column_value, count(*) AS n FROM d
 LEFT JOIN (SELECT * FROM r WHERE rank <= 15) a ON a.value = grp LEFT JOIN (SELECT * FROM r2 WHERE rank <= 8) b ON b.value = off GROUP BY 1, 2""", DIM, _TOP.format("grp"), _TOP.format("off").replace("r AS", "r2 AS", 1)), lambda t: O.capped_matrix(t, "group", "offering"))

# --- profile -----------------------------------------------------------------------------------
_PRESENT = " UNION ALL ".join(f"SELECT '{f}' AS field, 'PRESENT' AS status, count({known_sql(f)}) AS non_empty, count(*) - count({known_sql(f)}) AS empty, round(count({known_sql(f)}) / count(*), 6) AS coverage FROM annotated" for f in R.FIELDS[:-1])
query("profile_fields", sql(_PRESENT + " UNION ALL SELECT 'resolution_code', 'ABSENT', NULL, NULL, NULL"), R.field_presence)
query("profile_values", sql(" UNION ALL ".join(f"SELECT '{f}' AS field, {known_sql(f)} AS value, count(*) AS n FROM annotated WHERE {known_sql(f)} IS NOT NULL GROUP BY 2" for f in R.VALUE_FIELDS[:-1])), R.field_values)
_SIDE = "SELECT count(*) FILTER (k > 1) AS many, coalesce(max(k), 0) AS most FROM (SELECT {0}, count(*) AS k FROM pr GROUP BY 1)"
query("co_occurrence", sql(f"SELECT (SELECT CAST(sum(n) AS BIGINT) FROM pr) AS incidents, (SELECT count(*) FROM pr) AS pairs, a.many AS left_with_many, a.most AS max_right, b.many AS right_with_many, b.most AS max_left FROM ({_SIDE.format('svc')}) a, ({_SIDE.format('off')}) b", DIM, "pr AS (SELECT svc, off, count(*) AS n FROM d WHERE svc IS NOT NULL AND off IS NOT NULL GROUP BY 1, 2)"), lambda t: R.co_occurrence(t, "service", "service_offering"))
query("date_coverage", sql("SELECT min(nullif(closed, '')) AS first, max(nullif(closed, '')) AS last, count(nullif(closed, '')) AS dated, count(*) - count(nullif(closed, '')) AS undated FROM annotated"), lambda t: R.date_coverage(t, "closed"))
query("sla_signal", sql(f"SELECT CASE WHEN count(made_sla) = 0 THEN 'not-available' WHEN bool_and(made_sla) OR NOT bool_or(made_sla) THEN 'no-signal' ELSE 'available' END AS state, CASE WHEN bool_or(made_sla) AND NOT bool_and(made_sla) THEN {pct_sql('count(*) FILTER (NOT made_sla)', 'count(made_sla)')} END AS breach_pct, count(made_sla) AS recorded FROM annotated"), R.sla_signal)

# --- executive ---------------------------------------------------------------------------------
query("period_span", sql("SELECT count(DISTINCT month) AS months, min(month) AS first_month, max(month) AS last_month FROM annotated"), X.period_span)
query("top_share", sql("SELECT count(*) FILTER (rank <= 3) AS named, count(*) AS distinct_values, CAST(sum(n) FILTER (rank <= 3) AS BIGINT) AS n, round(sum(n) FILTER (rank <= 3) / (SELECT count(*) FROM d), 6) AS share FROM r", DIM, _TOP.format("svc")), lambda t: X.top_share(t, "service"))
query("look_dimension", sql("SELECT CASE WHEN count(DISTINCT grp) >= 2 THEN 'group' WHEN count(DISTINCT svc) >= 2 THEN 'service' WHEN count(DISTINCT off) >= 2 THEN 'offering' END AS dimension FROM d", DIM), X.look_dimension)
query("pattern_breadth", sql("SELECT category, count(DISTINCT grp) AS distinct_groups, count(DISTINCT svc) AS distinct_services, count(DISTINCT off) AS distinct_offerings FROM d GROUP BY 1", DIM), lambda t: X.pattern_breadth(t, KEY))
query("executive_metrics", sql(f"""SELECT count(*) AS total, round(count(*) FILTER (label IN ('Excellent', 'Good')) / count(*), 6) AS good_share, round(count(*) FILTER (root_cause = 0) / count(*), 6) AS no_diagnosis_share,
 round((SELECT sum(k) FROM kk) / count(*), 6) AS recurring_share, round((SELECT max(k) FROM kk) / count(*), 6) AS largest_share, count(DISTINCT month) AS months, min(month) AS first_month, max(month) AS last_month,
 round(median(resolution_hours), 6) AS median_hours, CASE WHEN count(DISTINCT grp) >= 2 THEN 'group' ELSE 'service' END AS dimension,
 {', '.join(f"count(DISTINCT {c}) AS {n}_values, round((SELECT sum(n) FROM (SELECT count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 3)) / count(*), 6) AS {n}_top_share" for n, c in _COL.items())} FROM d""", DIM, "kk AS (SELECT count(*) AS k FROM annotated GROUP BY category HAVING count(*) >= 2)"), lambda t: X.executive_metrics(t, KEY))

# --- weekly ------------------------------------------------------------------------------------
WEEKS = "wk AS (SELECT week, row_number() OVER (ORDER BY week) AS i FROM (SELECT DISTINCT week FROM annotated WHERE week <> '')), bl AS (SELECT a.week, b.week AS base_week FROM wk a JOIN wk b ON b.i < a.i AND b.i >= a.i - 4)"
query("available_weeks", sql("SELECT week FROM wk", WEEKS), W.available_weeks)
query("baseline_weeks", sql("SELECT * FROM bl", WEEKS), W.baselines)
query("weekly_volumes", sql(f"""SELECT week, n, {round1_sql('b')} AS baseline, CAST(CASE WHEN b > 0 THEN floor((n - b) / b * 100 + 0.5) ELSE 0 END AS BIGINT) AS delta_pct FROM (SELECT c.week, c.n, coalesce((SELECT avg(x.n) FROM bl JOIN cn x ON x.week = bl.base_week WHERE bl.week = c.week), 0.0) AS b FROM cn c)""", WEEKS, "cn AS (SELECT week, count(*) AS n FROM annotated GROUP BY 1)"), W.volumes)


def history_sql(value: str) -> str:
    return f"""cv AS (SELECT week, {value} AS value, count(*) AS n FROM annotated GROUP BY 1, 2),
hv AS (SELECT wk.week, v.value, coalesce(cv.n, 0) AS n, (SELECT count(*) FROM bl WHERE bl.week = wk.week) AS base_weeks, coalesce((SELECT sum(x.n) FROM bl JOIN cv x ON x.week = bl.base_week WHERE bl.week = wk.week AND x.value = v.value), 0) AS bsum
 FROM wk CROSS JOIN (SELECT DISTINCT value FROM cv) v LEFT JOIN cv ON cv.week = wk.week AND cv.value = v.value),
hx AS (SELECT *, bsum / greatest(base_weeks, 1) AS typical FROM hv)"""


query("category_movements", sql(f"""SELECT week, CAST(rank AS INTEGER) AS rank, value AS name, n, {round1_sql('typical')} AS baseline, round(n - typical, 6) AS change, delta_pct, CASE WHEN delta_pct >= 0 THEN 'up' ELSE 'down' END AS direction
 FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY abs(n - typical) DESC, n DESC, value COLLATE en) AS rank FROM (SELECT *, CAST(CASE WHEN typical > 0 THEN floor((n - typical) / typical * 100 + 0.5) ELSE 100 END AS BIGINT) AS delta_pct FROM hx WHERE n >= 3) WHERE abs(delta_pct) >= 25) WHERE rank <= 6""", WEEKS, history_sql("category")), W.movements)
query("week_problems", sql("""SELECT z.week, z.kind, CAST(rank AS INTEGER) AS rank, z.category, z.n, CASE WHEN z.kind = 'recurring' THEN coalesce(p.weeks_active, 1) ELSE 1 END AS weeks_active, CASE WHEN z.kind = 'recurring' THEN coalesce(p.is_chronic, false) ELSE false END AS is_chronic
 FROM (SELECT *, row_number() OVER (PARTITION BY week, kind ORDER BY n DESC, category) AS rank FROM (SELECT week, category, count(*) AS n, CASE WHEN EXISTS (SELECT 1 FROM bl JOIN annotated b ON b.week = bl.base_week WHERE bl.week = a.week AND b.category = a.category) THEN 'recurring' ELSE 'new' END AS kind FROM annotated a GROUP BY 1, 2) WHERE kind = 'recurring' OR n >= 2) z
 LEFT JOIN problem_table p ON p.category = z.category WHERE rank <= 8""", WEEKS, TABLE), lambda t: W.week_problems(t, KEY))
query("week_top_problems", sql("SELECT week, CAST(rank AS INTEGER) AS rank, category, n FROM (SELECT week, category, count(*) AS n, row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, category) AS rank FROM annotated GROUP BY 1, 2 HAVING count(*) >= 2) WHERE rank <= 10"), lambda t: W.top_problems(t, KEY))
query("week_actions", sql("""SELECT category, kind, n FROM (SELECT p.category, p.n, CASE WHEN rca_coverage < 50 THEN 'problem-management' WHEN median_hours <= 2 THEN 'automation' WHEN k >= 3 AND top < 40 THEN 'knowledge-gap' WHEN is_chronic THEN 'chronic' END AS kind FROM problem_table p
 LEFT JOIN (SELECT category, count(*) AS k, arg_min(pct, rank) AS top FROM top_causes GROUP BY 1) c ON c.category = p.category WHERE p.n >= greatest(3, floor((SELECT count(*) FROM annotated) * 0.01 + 0.5))) WHERE kind IS NOT NULL
 ORDER BY CASE kind WHEN 'problem-management' THEN 0 WHEN 'chronic' THEN 1 WHEN 'automation' THEN 2 ELSE 3 END, n DESC, category LIMIT 6""", "whole AS (SELECT * FROM annotated)", *[x.replace("annotated", "one_week") for x in ("one_week AS (SELECT * FROM whole WHERE week = '2024-W09')", TABLE, CAUSES)]).replace("(SELECT count(*) FROM annotated) * 0.01", "(SELECT count(*) FROM one_week) * 0.01"), lambda t: W.digest(t, "2024-W09", KEY)["actions"].select(KEY, "kind", "n"))
_ACTIONS = SQL["week_actions"]


def digest_sql() -> str:
    """The parts' own statements, for one week, one after another."""
    part = lambda name, columns, where="week = '2024-W09'": f"SELECT {columns} FROM ({SQL[name]}) WHERE {where}"
    return " UNION ALL ".join((
        part("weekly_volumes", "'volume' AS section, CAST(1 AS INTEGER) AS rank, week AS name, n, CAST(delta_pct AS VARCHAR) AS detail"),
        part("category_movements", "'movements', CAST(rank AS INTEGER), name, CAST(n AS BIGINT), CAST(delta_pct AS VARCHAR)"),
        part("week_problems", "kind, CAST(rank AS INTEGER), category, n, CAST(weeks_active AS VARCHAR)"),
        part("week_top_problems", "'top', rank, category, n, CAST(NULL AS VARCHAR)"),
        f"SELECT 'actions', CAST(row_number() OVER (ORDER BY {_PRIORITY}, n DESC, category) AS INTEGER), category, n, kind FROM ({_ACTIONS})",
    ))


_PRIORITY = "CASE kind WHEN 'problem-management' THEN 0 WHEN 'chronic' THEN 1 WHEN 'automation' THEN 2 ELSE 3 END"


def _kept_digest(t: DataFrame) -> DataFrame:
    """The digest from a state that batches keep: half of the tickets, the rest twice under one name, a batch by mistake, and its revocation."""
    state = WeekState(t.sparkSession, scratch(t.sparkSession, "weeks"), KEY)
    rows = t.select("row_id", "week", "category")
    odd = F.col("row_id") % 2 == 1
    for name, part, sign in (("odd", rows.filter(odd), 1), ("even", rows.filter(~odd), 1), ("even", rows.filter(~odd), 1), ("mistake", rows.filter("row_id % 3 = 0"), 1), ("revoked", rows.filter("row_id % 3 = 0"), -1)):
        state.commit(name, part, sign)
    parts = {k: v.withColumnRenamed("key", KEY) for k, v in state.review("2024-W09").items()}
    actions = P.recommend(t.filter("week = '2024-W09'"), KEY).orderBy("priority", F.desc("n"), KEY).limit(6)
    return W.as_table({**parts, "actions": actions}, KEY)


query("week_digest", digest_sql(), lambda t: W.digest_table(t, "2024-W09", KEY))
query("week_digest_kept", digest_sql(), _kept_digest)
query("week_bridge", sql("""SELECT week, nullif(value, '') AS value, n, round(typical, 6) AS typical, round(n - typical, 6) AS change FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY abs(n - typical) DESC, n DESC, value COLLATE en) AS r FROM hx WHERE base_weeks > 0 AND n <> typical) WHERE r = 1""", WEEKS, history_sql("coalesce(service, '')")), lambda t: W.bridge(t, "service"))
query("data_through", sql("SELECT max(opened) AS through FROM annotated"), W.data_through)
query("week_comparable", sql("SELECT DISTINCT week, (SELECT CAST(max(opened) AS DATE) FROM annotated) >= CAST(date_trunc('week', CAST(opened AS TIMESTAMP)) AS DATE) + 6 AS comparable FROM annotated"), W.comparable)
query("calendar_weeks", sql("SELECT strftime(d, '%G-W%V') AS week FROM (SELECT unnest(generate_series((SELECT date_trunc('week', CAST(min(opened) AS TIMESTAMP)) FROM annotated)::TIMESTAMP, (SELECT CAST(max(opened) AS TIMESTAMP) FROM annotated), INTERVAL 7 DAY)) AS d)"), W.calendar_weeks)
query("weeks_of_months", sql("SELECT DISTINCT strftime(d, '%G-W%V') AS week FROM (SELECT unnest(generate_series((SELECT date_trunc('week', CAST(min(opened) AS TIMESTAMP)) FROM annotated)::TIMESTAMP, (SELECT date_trunc('week', CAST(max(opened) AS TIMESTAMP)) FROM annotated)::TIMESTAMP + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS d) WHERE strftime(d, '%Y-%m') = '2024-02'"), lambda t: W.weeks_of_months(t, ["2024-02"]))
query("composition_dimension", sql("SELECT CASE WHEN s >= 2 THEN 'A' WHEN o >= 2 THEN CASE WHEN s = 1 THEN 'B' ELSE 'C' END WHEN g >= 2 THEN 'D' ELSE 'E' END AS kind, CASE WHEN s >= 2 THEN 'service' WHEN o >= 2 THEN 'service_offering' WHEN g >= 2 THEN 'assignment_group' END AS dimension, CAST(NULL AS VARCHAR) AS single_service, CAST(NULL AS BIGINT) AS single_missing FROM (SELECT count(DISTINCT service) AS s, count(DISTINCT service_offering) AS o, count(DISTINCT assignment_group) AS g FROM annotated)"), W.composition_dimension)
query("weekly_composition", sql("SELECT week, CASE WHEN grp IS NULL THEN 'missing' ELSE coalesce('value:' || a.value, 'others') END AS segment, count(*) AS n FROM d LEFT JOIN (SELECT * FROM r WHERE rank <= 5) a ON a.value = grp GROUP BY 1, 2", DIM, _TOP.format("grp")), lambda t: W.composition(t, "assignment_group"))

# --- clusters and families ----------------------------------------------------------------------
OPEN = "ot AS (SELECT row_id, concat(short_desc_clean, chr(10), desc_clean) AS text FROM annotated)"
NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
query("family_text", sql(f"SELECT row_id, {NORMAL.format('text')} AS text FROM ot", OPEN), lambda t: M.variant(t, "R0"))
LINES = rf"ln AS (SELECT row_id, pos, parts[pos] AS line, regexp_replace({NORMAL.format('parts[pos]')}, '\p{{Nd}}+', '0', 'g') AS line_key FROM (SELECT row_id, string_split(text, chr(10)) AS parts FROM ot), range(1, len(parts) + 1) AS g(pos)), tl AS (SELECT line_key, count(DISTINCT row_id) AS df FROM ln WHERE len(regexp_extract_all(line_key, '[\p{{L}}\p{{N}}_]+')) >= 3 GROUP BY 1 HAVING count(DISTINCT row_id) / (SELECT count(*) FROM ot) >= 0.02)"
query("template_lines", sql("SELECT * FROM tl", OPEN, LINES), lambda t: M.template_lines(M.open_text(t), 0.02))
GRAMS = r"""kp AS (SELECT row_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM ln WHERE line_key NOT IN (SELECT line_key FROM tl) GROUP BY 1),
kw AS (SELECT ot.row_id, regexp_extract_all(coalesce(kept, ''), '[\p{L}\p{N}_]+') AS words FROM ot LEFT JOIN kp ON kp.row_id = ot.row_id),
kg AS (SELECT row_id, i, array_to_string(list_transform(words[i:i + 4], lambda w: regexp_replace(lower(w), '\p{Nd}+', '0', 'g')), chr(1)) AS gram FROM kw, range(1, len(words) - 3) AS g(i)),
tg AS (SELECT gram, count(DISTINCT row_id) AS df FROM kg GROUP BY 1 HAVING count(DISTINCT row_id) / (SELECT count(*) FROM ot) >= 0.02),
hit AS (SELECT DISTINCT row_id, i + k AS p FROM kg, range(0, 5) AS h(k) WHERE gram IN (SELECT gram FROM tg)),
r1 AS (SELECT kw.row_id, coalesce(string_agg(words[p], ' ' ORDER BY p) FILTER (p IS NOT NULL), '') AS text FROM kw LEFT JOIN (SELECT row_id, p FROM kw, range(1, len(words) + 1) AS x(p) WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.row_id = kw.row_id AND hit.p = x.p)) left_over ON left_over.row_id = kw.row_id GROUP BY 1)"""
query("template_grams", sql("SELECT replace(gram, chr(1), ' ') AS gram, df FROM tg", OPEN, LINES, GRAMS), lambda t: (lambda x: M.template_grams(x, M.template_lines(x, 0.02), 0.02).withColumn("gram", F.replace("gram", F.lit("\x01"), F.lit(" "))))(M.open_text(t)))
query("family_text_r1", sql(f"SELECT row_id, {NORMAL.format('text')} AS text FROM r1", OPEN, LINES, GRAMS), lambda t: M.variant(t, "R1", 0.02))
_ID = r"CASE WHEN regexp_matches(w, '^[0-9a-fA-F]{8,}$') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-fA-F]') THEN 'tokhex' WHEN length(w) >= 4 AND regexp_matches(w, '\p{Nd}') AND regexp_matches(w, '[\p{L}\p{Nl}\p{No}]') THEN 'tokid' WHEN regexp_matches(w, '^\p{Nd}+$') THEN 'toknum' ELSE w END"
query("family_text_r2", sql(f"SELECT row_id, {NORMAL.format('text2')} AS text FROM (SELECT row_id, array_to_string(list_transform(string_split(text, ' '), lambda w: {_ID}), ' ') AS text2 FROM r1)", OPEN, LINES, GRAMS), lambda t: M.variant(t, "R2", 0.02))
TFIDF = rf"""tw AS (SELECT row_id, regexp_extract_all(lower({NORMAL.format('text')}), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM ot),
tt AS (SELECT row_id, w[i] AS term FROM tw, range(1, len(w) + 1) AS g(i) UNION ALL SELECT row_id, concat(w[i], ' ', w[i + 1]) FROM tw, range(1, len(w)) AS g(i)),
tc AS (SELECT row_id, term, count(*) AS c FROM tt GROUP BY 1, 2), td AS (SELECT term, count(*) AS df FROM tc GROUP BY 1),
tx AS (SELECT row_id, term, (ln(c) + 1) * (ln(((SELECT count(*) FROM ot) + 1) / (df + 1)) + 1) AS x FROM tc JOIN td USING (term)),
tv AS (SELECT row_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS weight FROM tx)"""
QUERIES["tfidf"] = lambda spark, sf_dir: M.tfidf(M.variant(family_table(spark, sf_dir))).withColumn("weight", F.round("weight", 6))
SQL["tfidf"] = sql("SELECT row_id, term, round(weight, 6) AS weight FROM tv", OPEN, TFIDF)


def _partitioned(make: Callable) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        t = family_table(spark, sf_dir)
        return make(t, lambda s=0.6: M.families(t, stored(M.cosine_edges(M.variant(t), s)), s))

    return run


EDGES = "eg AS (SELECT a.row_id AS src, b.row_id AS dst, sum(a.weight * b.weight) AS cos FROM tv a JOIN tv b ON a.term = b.term AND a.row_id < b.row_id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.6 - 1e-9)"
PARTS = """reach AS (SELECT row_id AS node, row_id AS low FROM ot UNION SELECT e.dst, r.low FROM reach r JOIN (SELECT src, dst FROM eg UNION ALL SELECT dst, src FROM eg) e ON e.src = r.node),
cp AS (SELECT node AS row_id, min(low) AS comp FROM reach GROUP BY 1), sz AS (SELECT comp, count(*) AS k FROM cp GROUP BY 1),
fam AS (SELECT cp.row_id, f AS family FROM cp LEFT JOIN (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS f FROM sz WHERE k >= 2) n ON n.comp = cp.comp)"""


def family_sql(select: str, *more: str) -> str:
    return sql(select, OPEN, TFIDF, EDGES, PARTS, *more).replace("WITH base AS", "WITH RECURSIVE base AS", 1)


def family_query(name: str, statement: str | None, make: Callable) -> None:
    QUERIES[name] = _partitioned(make)
    if statement is not None:
        SQL[name] = statement


family_query("families", family_sql("SELECT row_id, family FROM fam"), lambda t, fam: fam())
family_query("family_threshold", family_sql("SELECT 0.6::DOUBLE AS threshold, count(*) FILTER (family IS NOT NULL) AS families_2, count(*) FILTER (family IS NOT NULL AND n >= 5) AS families_5, round(coalesce(max(n) FILTER (family IS NOT NULL), 0) / sum(n), 6) AS largest_share, round(coalesce(sum(n) FILTER (family IS NULL), 0) / sum(n), 6) AS alone_share FROM (SELECT family, count(*) AS n FROM fam GROUP BY 1)"), lambda t, fam: M.threshold_table(fam().select("row_id", F.lit(0.6).alias("threshold"), "family")))
family_query("family_reconciliation", family_sql("SELECT week, count(*) AS n, count(family) AS in_families, count(*) - count(family) AS alone FROM annotated JOIN fam USING (row_id) GROUP BY 1"), lambda t, fam: M.reconciliation(t, fam()))
family_query("family_week_summary", family_sql("SELECT week, count(*) AS total, count(family) AS grouped, count(*) - count(family) AS alone, count(DISTINCT family) AS groups FROM annotated JOIN fam USING (row_id) GROUP BY 1"), lambda t, fam: M.week_summary(t, fam()))
family_query("family_history", family_sql("SELECT family, count(*) AS total, min(opened) AS first_seen FROM annotated JOIN fam USING (row_id) WHERE family IS NOT NULL GROUP BY 1"), lambda t, fam: M.history(t, fam()))
family_query("family_concentration", family_sql("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(coalesce(sum(n), 0) / (SELECT count(*) FROM fam), 6) AS share FROM (SELECT count(*) AS n FROM fam WHERE family IS NOT NULL GROUP BY family ORDER BY n DESC LIMIT 5)"), lambda t, fam: M.concentration(fam()))
family_query("family_week_change", family_sql("""SELECT g.family, g.week, g.n, round(ty, 6) AS typical, round(g.n - ty, 6) AS change, CASE WHEN ty > 0 THEN CAST(floor((g.n - ty) / ty * 100 + 0.5) AS BIGINT) END AS pct, coalesce(ty = 0 AND g.n > 0, false) AS is_new FROM
 (SELECT *, avg(n) OVER (PARTITION BY family ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ty FROM (SELECT f.family, wk.week, count(a.row_id) AS n FROM (SELECT DISTINCT family FROM fam WHERE family IS NOT NULL) f CROSS JOIN wk LEFT JOIN (SELECT row_id, week, family AS fm FROM annotated JOIN fam USING (row_id)) a ON a.fm = f.family AND a.week = wk.week GROUP BY 1, 2)) g""", WEEKS), lambda t, fam: M.week_change(t.join(fam().filter("family IS NOT NULL"), "row_id"), t).withColumns({"typical": F.round("typical", 6), "change": F.round("change", 6)}))

def largest_sql(table: str, order: str, part: str = "") -> str:
    """Whole percentages of n that sum to 100, as ``largest_remainder`` gives them."""
    share = f"SELECT *, CASE WHEN sum(n) OVER ({part}) > 0 THEN n * CAST(100 AS DOUBLE) / sum(n) OVER ({part}) END AS _x FROM {table}"
    return f"(SELECT *, CAST(CASE WHEN _x IS NULL THEN 0 ELSE _f + CASE WHEN row_number() OVER ({part} ORDER BY _x - _f DESC, {order}) <= 100 - sum(_f) OVER ({part}) THEN 1 ELSE 0 END END AS BIGINT) AS pct FROM (SELECT *, floor(_x) AS _f FROM ({share})))"


def breakdown_sql(dimension: str, name: str) -> str:
    return f"""{name}_c AS (SELECT family, {known_sql(dimension)} AS value, count(*) AS n FROM annotated JOIN fam USING (row_id) WHERE family IS NOT NULL GROUP BY 1, 2),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, value IS NULL, value COLLATE en, value) AS r FROM {name}_c),
{name}_g AS (SELECT family, least(r, 6) AS place, max(CASE WHEN r <= 5 THEN coalesce(value, '(none)') ELSE 'Other' END) AS value, count(*) AS entries, CAST(sum(n) AS BIGINT) AS n FROM {name}_r GROUP BY 1, 2),
{name} AS (SELECT family, CAST(place AS INTEGER) AS place, value, entries, n, pct FROM {largest_sql(f"{name}_g", "place", "PARTITION BY family")})"""


LIST_HASH = "sha256(concat('[\"', array_to_string(list_sort(list({0})), '\",\"'), '\"]'))"
MEMBER = "sha256(concat('FAM-01|', number))"
IDENTITY = f"""mem AS (SELECT family, {MEMBER} AS m FROM annotated JOIN fam USING (row_id) WHERE family IS NOT NULL),
fh AS (SELECT family, count(*) AS size, {LIST_HASH.format('m')} AS h FROM mem GROUP BY 1),
idn AS (SELECT family, size, concat('F', printf('%03d', row_number() OVER (ORDER BY size DESC, h))) AS display_id FROM fh)"""
CALENDAR = "cw AS (SELECT strftime(d, '%G-W%V') AS week FROM (SELECT unnest(generate_series((SELECT date_trunc('week', CAST(min(opened) AS TIMESTAMP)) FROM annotated)::TIMESTAMP, (SELECT CAST(max(opened) AS TIMESTAMP) FROM annotated), INTERVAL 7 DAY)) AS d))"


def change_sql(rows: str, name: str) -> str:
    """Counts of each family in ``rows`` on every week with data, and what is typical before each."""
    return f"""{name}_g AS (SELECT f.family, wk.week, count(v.row_id) AS n FROM (SELECT DISTINCT family FROM {rows}) f CROSS JOIN wk LEFT JOIN {rows} v ON v.family = f.family AND v.week = wk.week GROUP BY 1, 2),
{name} AS (SELECT *, avg(n) OVER (PARTITION BY family ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ty FROM {name}_g)"""


FAMILY_ROWS = "fr AS (SELECT a.*, family FROM annotated a JOIN fam USING (row_id) WHERE family IS NOT NULL)"
SEEN_ROWS = f"vr AS (SELECT * FROM fr WHERE {_MONTHS})"
VECTORS = """rw AS (SELECT family, row_id, term, weight FROM tv JOIN fam USING (row_id) WHERE family IS NOT NULL), tot AS (SELECT family, term, sum(weight) AS s FROM rw GROUP BY 1, 2),
dt AS (SELECT family, row_id, sum(weight * s) AS vs, sum(weight * weight) AS vv FROM rw JOIN tot USING (family, term) GROUP BY 1, 2),
cl AS (SELECT family, row_id, round((vs - vv) / (m - 1), 9) AS closeness FROM dt JOIN (SELECT family, count(*) AS m FROM fam GROUP BY 1) USING (family)),
rep AS (SELECT family, row_id, closeness FROM (SELECT cl.*, row_number() OVER (PARTITION BY family ORDER BY closeness DESC, opened, """ + MEMBER + """) AS r FROM cl JOIN annotated USING (row_id)) WHERE r = 1)"""
family_query("family_composition", family_sql("SELECT kind, groups, n, pct FROM " + largest_sql("(SELECT CASE WHEN family IS NULL THEN 'one-off' ELSE 'repeating' END AS kind, count(DISTINCT family) AS groups, count(*) AS n FROM fam GROUP BY 1)", "CASE WHEN kind = 'repeating' THEN 0 ELSE 1 END")), lambda t, fam: M.composition(fam()))
family_query("family_segments", family_sql("SELECT CASE o WHEN 0 THEN 'top 5' WHEN 1 THEN 'next 20' WHEN 2 THEN 'remaining' ELSE 'one-off' END AS segment, groups, n, pct FROM " + largest_sql("""(SELECT o, CAST(sum(k) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN r <= 5 THEN 0 WHEN r <= 25 THEN 1 ELSE 2 END AS o, n, 1 AS k FROM
 (SELECT n, row_number() OVER (ORDER BY n DESC, family) AS r FROM fs WHERE family IS NOT NULL) UNION ALL SELECT 3, n, 0 FROM fs WHERE family IS NULL) GROUP BY o)""", "o"), "fs AS (SELECT family, count(*) AS n FROM fam GROUP BY 1)"), lambda t, fam: M.segments(fam()))
family_query("family_breakdown", family_sql("SELECT * FROM bd", breakdown_sql("assignment_group", "bd")), lambda t, fam: M.breakdown(t, fam(), "assignment_group"))
family_query("family_identity", family_sql("SELECT * FROM idn", IDENTITY), lambda t, fam: M.identity(t, checkpoint(fam())))
family_query("family_partition_hash", family_sql("SELECT sha256(CAST(to_json(coalesce(list_sort(list(l)), [])) AS VARCHAR)) AS hash FROM (SELECT list_sort(list(sha256(concat('C-REAL-04|tickets|', trim(number))))) AS l FROM annotated JOIN fam USING (row_id) WHERE family IS NOT NULL GROUP BY family)"), lambda t, fam: M.partition_hash(t, fam()))
family_query("family_rows", family_sql("""SELECT i.family, i.size, i.display_id, in_view, services, offerings, groups, no_service_share, weeks_present, c.n AS week_n, round(ty, 6) AS typical, round(c.n - ty, 6) AS change, CASE WHEN ty > 0 THEN CAST(floor((c.n - ty) / ty * 100 + 0.5) AS BIGINT) END AS pct,
 coalesce(ty = 0 AND c.n > 0, false) AS is_new, weeks_present >= 3 AS recurring FROM idn i JOIN (SELECT family, count(*) AS in_view, count(DISTINCT service) AS services, count(DISTINCT service_offering) AS offerings, count(DISTINCT """ + known_sql("assignment_group") + """) AS groups, round(count(*) FILTER (service IS NULL) / count(*), 6) AS no_service_share,
 count(DISTINCT nullif(week, '')) AS weeks_present FROM vr GROUP BY 1) s ON s.family = i.family LEFT JOIN (SELECT * FROM vc WHERE week = '2024-W09') c ON c.family = i.family""", IDENTITY, WEEKS, FAMILY_ROWS, SEEN_ROWS, change_sql("vr", "vc")), lambda t, fam: (lambda f: M.family_rows(t, f, filtered(t, Filters(FILTERS.months)), "2024-W09"))(checkpoint(fam())))
family_query("family_cards", family_sql("""SELECT i.family, i.size, i.display_id, total, weeks_appeared, last_seen, first_seen, weekly, c.n AS week_n, CASE WHEN comparable THEN round(ty, 6) END AS typical, CASE WHEN comparable THEN round(c.n - ty, 6) END AS change,
 g.value AS top_group, g.pct AS top_group_pct, g.pct < 50 AS mixed_group, v.value AS top_service, v.pct AS top_service_pct, v.pct < 50 AS mixed_service FROM idn i
 JOIN (SELECT family, count(*) AS total, count(DISTINCT nullif(week, '')) AS weeks_appeared, max(opened) AS last_seen, min(opened) AS first_seen FROM fr GROUP BY 1) b ON b.family = i.family
 JOIN (SELECT family, string_agg(CAST(n AS VARCHAR), ',' ORDER BY week) AS weekly FROM (SELECT f.family, cw.week, count(fr.row_id) AS n FROM (SELECT DISTINCT family FROM fr) f CROSS JOIN cw LEFT JOIN fr ON fr.family = f.family AND fr.week = cw.week GROUP BY 1, 2) GROUP BY 1) l ON l.family = i.family
 LEFT JOIN (SELECT fc.*, (SELECT CAST(max(opened) AS DATE) FROM annotated) >= (SELECT CAST(date_trunc('week', CAST(max(opened) AS TIMESTAMP)) AS DATE) + 6 FROM annotated WHERE week = '2024-W09') AS comparable FROM fc WHERE week = '2024-W09') c ON c.family = i.family
 JOIN (SELECT * FROM bg WHERE place = 1) g ON g.family = i.family JOIN (SELECT * FROM bv WHERE place = 1) v ON v.family = i.family""", IDENTITY, WEEKS, CALENDAR, FAMILY_ROWS, change_sql("fr", "fc"), breakdown_sql("assignment_group", "bg"), breakdown_sql("service", "bv")), lambda t, fam: M.cards(t, checkpoint(fam()), "2024-W09").withColumn("weekly", F.array_join(F.transform("weekly", lambda x: x.cast("string")), ",")))
CARD_ORDER = """SELECT family, display_id, total, week_n, row_number() OVER (ORDER BY {0}total DESC, CAST(substring(display_id, 2) AS BIGINT)) AS place FROM (SELECT i.family, display_id, count(*) AS total, count(*) FILTER (week = '2024-W09') AS week_n FROM idn i JOIN fr ON fr.family = i.family GROUP BY 1, 2)"""
for _name, _by_week in (("family_card_order", False), ("family_card_order_week", True)):
    family_query(_name, family_sql(CARD_ORDER.format("week_n DESC, " if _by_week else ""), IDENTITY, FAMILY_ROWS), lambda t, fam, by_week=_by_week: M.ordered_cards(M.cards(t, checkpoint(fam()), "2024-W09"), by_week).select("family", "display_id", "total", "week_n", "place"))
family_query("family_activity", family_sql("SELECT f.family, cw.week, (SELECT count(*) FROM vr WHERE vr.family = f.family AND vr.week = cw.week) AS in_view, (SELECT count(*) FROM fr WHERE fr.family = f.family AND fr.week = cw.week) AS whole FROM (SELECT DISTINCT family FROM fr) f CROSS JOIN cw", CALENDAR, FAMILY_ROWS, SEEN_ROWS), lambda t, fam: M.activity(t, checkpoint(fam()), filtered(t, Filters(FILTERS.months))))
family_query("family_representatives", family_sql("SELECT family, row_id, round(closeness, 6) AS closeness FROM rep", VECTORS), lambda t, fam: M.representatives(t, stored(fam())).withColumn("closeness", F.round("closeness", 6)))
family_query("family_common_words", family_sql("SELECT family, CAST(rank AS INTEGER) AS rank, term FROM (SELECT family, term, row_number() OVER (PARTITION BY family ORDER BY w DESC, term) AS rank FROM (SELECT family, term, round(sum(weight), 9) AS w FROM rw WHERE NOT regexp_matches(term, '(^| )tok(hex|id|num)( |$)') GROUP BY 1, 2)) WHERE rank <= 5", VECTORS), lambda t, fam: M.common_words(t, stored(fam())))
family_query("family_names", family_sql(r"SELECT family, CASE WHEN length(first) > 80 THEN concat(substring(first, 1, 79), '…') ELSE first END AS name FROM nm", VECTORS, r"""nl AS (SELECT family, i, trim(regexp_replace(regexp_replace(parts[i], '\[URL\]|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM (SELECT family, string_split(text, chr(10)) AS parts FROM rep JOIN ot USING (row_id)), range(1, len(parts) + 1) AS g(i)),
nm AS (SELECT family, coalesce(arg_min(line, i) FILTER (len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '\p{L}'))) >= 3), arg_min(line, i) FILTER (line <> ''), '') AS first FROM nl GROUP BY 1)"""), lambda t, fam: M.representatives(t, stored(fam())).join(M.open_text(t), "row_id").select("family", M.group_name(F.col("text")).alias("name")))


def partitions_sql() -> str:
    ctes, selects = [EDGES.replace("0.6 - 1e-9", "0.5 - 1e-9")], []
    for i, s in enumerate(M.THRESHOLDS):
        part = PARTS.replace("FROM eg", f"FROM eg WHERE cos >= {s} - 1e-9")
        for name in ("reach", "cp", "sz", "fam"):
            part = re.sub(rf"\b{name}\b", f"{name}{i}", part)
        ctes.append(part)
        selects.append(f"SELECT row_id, CAST({s} AS DOUBLE) AS threshold, family FROM fam{i}")
    return sql(" UNION ALL ".join(selects), OPEN, TFIDF, *ctes).replace("WITH base AS", "WITH RECURSIVE base AS", 1)


family_query("family_partitions", partitions_sql(), lambda t, fam: M.partitions(t))
family_query("family_member_list", family_sql("SELECT row_id, number, opened FROM annotated JOIN fam USING (row_id) WHERE family = 0"), lambda t, fam: M.family_members(t, checkpoint(fam()), 0, newest=True).select("row_id", "number", "opened"))
family_query("cosine_edges", family_sql("SELECT src, dst, round(least(cos, 1.0), 6) AS cos FROM eg"), lambda t, fam: M.cosine_edges(M.variant(t), 0.6).withColumn("cos", F.round("cos", 6)))
query("problem_clusters", None, lambda t: C.cluster(t).select("row_id", "cluster_id"))
query("clustered_problems", None, lambda t: (lambda x: S.problem_sheet(x))(checkpoint(C.cluster(t))))
query("clustered_week_problems", None, lambda t: W.week_problems(checkpoint(C.cluster(t))))
query("clustered_actions", None, lambda t: P.recommend(checkpoint(C.cluster(t))))
