"""DuckDB SQL for the same results: common table expressions from the star tables to annotated incidents."""

from __future__ import annotations

from ticketlens import config
from ticketlens.sources.view import TEMPLATES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alternation(phrases) -> str:
    out = []
    for p in phrases:
        out.append("".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in p))
    return "|".join(out)


_TEMPLATE_ROWS = ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(TEMPLATES))

INCIDENTS = f"""base AS (
 SELECT d.doc_id, d.text, d.lang, d.source, e.user_id, e.event_type, e.value, o.o_orderstatus, o.o_orderpriority,
        tpl.short_text, tpl.note_text, l.quality, e.ts + to_days(CAST(d.doc_id % 13 * 7 AS INTEGER)) AS opened_ts
 FROM documents d JOIN events e ON e.event_id = d.doc_id JOIN orders o ON o.o_orderkey = d.doc_id
 JOIN (VALUES {_TEMPLATE_ROWS}) AS tpl(tid, short_text, note_text) ON tpl.tid = d.doc_id % 8
 LEFT JOIN labels l ON l.doc_id = d.doc_id),
talk AS (
 SELECT c.conv_id, c.turn, concat(strftime(b.opened_ts + to_minutes(CAST(c.turn * 10 + 5 AS BIGINT)), '%Y-%m-%d %H:%M:%S'), ' - ', c.role, ' (Work notes)', chr(10), c.text) AS line
 FROM conversations c JOIN base b ON b.doc_id = c.conv_id),
journal AS (SELECT conv_id, string_agg(line, concat(chr(10), chr(10)) ORDER BY turn) AS journal FROM talk GROUP BY conv_id),
incidents AS (
 SELECT b.doc_id AS row_id, concat('INC', lpad(CAST(b.doc_id AS VARCHAR), 7, '0')) AS number, 'Incident' AS task_type, b.o_orderpriority AS priority,
  CASE b.o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'P' THEN 'Resolved' ELSE 'New' END AS state,
  CASE WHEN b.doc_id % 10 = 9 THEN split_part(b.text, chr(10), 1) ELSE concat(b.short_text, ' INC', CAST(b.doc_id AS VARCHAR)) END AS short_description,
  b.text AS description,
  concat(strftime(b.opened_ts + to_minutes(1), '%Y-%m-%d %H:%M:%S'), ' - System (Work notes)', chr(10), 'Task is created by system', chr(10), chr(10),
   strftime(b.opened_ts + to_minutes(3), '%Y-%m-%d %H:%M:%S'), ' - user_', CAST(b.user_id AS VARCHAR), ' (Work notes)', chr(10), b.note_text,
   CASE WHEN j.journal IS NULL THEN '' ELSE concat(chr(10), chr(10), j.journal) END) AS work_notes,
  b.source AS assignment_group, concat('user_', CAST(b.user_id AS VARCHAR)) AS assigned_to, strftime(b.opened_ts, '%Y-%m-%d %H:%M:%S') AS opened,
  CASE WHEN b.o_orderstatus = 'O' THEN '' ELSE strftime(b.opened_ts + to_minutes(CAST(floor(b.value) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS closed,
  b.event_type AS channel, CASE WHEN b.quality IS NULL THEN NULL ELSE b.quality = 1 END AS made_sla,
  CASE WHEN b.doc_id % 20 = 19 THEN '' ELSE b.lang END AS service,
  CASE WHEN b.doc_id % 15 = 14 THEN '' ELSE concat('offering_', CAST(b.doc_id % 9 AS VARCHAR)) END AS service_offering
 FROM base b LEFT JOIN journal j ON j.conv_id = b.doc_id)"""


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    for pattern, by in ((r"_x000D_", "chr(10)"), (r"\r\n?", "chr(10)"), (r"\[/?code\]", "''"), (r"<[^>]+>", "''"), (r"https?://\S+", "'[URL]'"), (r"nav_to\.do\S+", "'[URL]'"), (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z", "''"), (r"\s{3,}", "'  '")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return trim_sql(x)


_HEADER = r"(?m)^[ \t]*((?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})[ T]+\d{1,2}:\d{2}(?::\d{2})?(?:[ \t]*[AaPp][Mm])?)[ \t]*-[ \t]*([^\n]+?)[ \t]*\([^()\n]+\)[ \t]*$"

NOTES = f"""e0 AS (SELECT *, {clean_sql('short_description')} AS short_desc_clean, {clean_sql('description')} AS desc_clean,
  regexp_matches(lower(description), {q(alternation(config.AUTO_DESCRIPTION_PHRASES))}) AS is_auto_desc,
  string_split(regexp_replace(work_notes, {q(_HEADER)}, concat(chr(1), '\\1', chr(2), '\\2', chr(3)), 'g'), chr(1)) AS parts FROM incidents),
cuts AS (SELECT row_id, i - 1 AS pos, parts[i] AS part FROM e0, range(2, len(parts) + 1) AS r(i)),
notes0 AS (SELECT row_id, pos, {trim_sql('split_part(part, chr(2), 1)')} AS noted_at, {trim_sql('split_part(split_part(part, chr(2), 2), chr(3), 1)')} AS author, {clean_sql('split_part(part, chr(3), 2)')} AS note FROM cuts),
notes AS (SELECT *, lower(author) = 'system' OR regexp_matches(lower(note), {q(alternation(config.SYSTEM_PHRASES))}) AS is_system FROM notes0),
human AS (SELECT row_id, list(note ORDER BY pos) AS texts FROM notes WHERE NOT is_system GROUP BY row_id),
enriched AS (SELECT e0.* EXCLUDE (parts), coalesce(human.texts, CAST([] AS VARCHAR[])) AS texts,
  array_to_string(list_prepend(desc_clean, coalesce(human.texts, CAST([] AS VARCHAR[]))), chr(10)) AS combined FROM e0 LEFT JOIN human USING (row_id))"""

_TRIPLE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_NOISE = (
    r"^hi team[,.]?\s*(please\s+)?(assist|check|help|look into|provide assistance)", r"^please (check|assist|help|look into|take a look)",
    r"^(hardware/dispatch|software/application)\s*\n?\s*\w*\s*$", r"^(na|n/a)\s*$", r"^predicted ag:", r"^attachment added\s*$", r"^(hi|hello|dear)\s+team",
    r"this incident will be closed due (yo|to) has been completed",
)
_SLANG = (
    (r"(?i)\bwip\b", "Filler: WIP"), (r"(?i)\btbd\b", "Vague: TBD"), (r"(?i)\bgonna\b", "Informal: gonna"), (r"(?i)\bwanna\b", "Informal: wanna"),
    (r"(?i)\bpls\b|\bplz\b", "Informal: pls/plz"), (r"(?i)due (yo)\b", "Typo: due yo"), (r"(?im)^hi[,.]?\s*team", "Generic opener: Hi team"),
    (r"(?i)please (check|assist|help)\s+the?\s*user", "Vague handoff"),
)
_NOISY = " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in _NOISE)
_ISSUES = " + ".join(f"CASE WHEN regexp_matches(combined, '{p}') THEN 1 ELSE 0 END" for p, _ in _SLANG)

SCORED = f"""s0 AS (SELECT *, list_filter(regexp_split_to_array(combined, '\\s+'), lambda x: length(x) > 1) AS words, len(texts) AS note_count,
  CAST(coalesce(list_sum(list_transform(texts, lambda x: length(x))), 0) AS BIGINT) AS note_chars,
  len(list_filter(texts, lambda x: length(x) < 12 OR {_NOISY})) AS noisy, {_ISSUES} AS issues FROM enriched),
s1 AS (SELECT *, CASE WHEN length(short_desc_clean) <= 9 THEN 0 WHEN length(short_desc_clean) <= 24 THEN 40 WHEN regexp_matches(short_desc_clean, '^\\[.+?\\]\\[.+?\\]') THEN 60 ELSE 100 END AS short_score,
  CASE WHEN is_auto_desc THEN 70 WHEN length(desc_clean) <= 49 THEN 0 WHEN length(desc_clean) <= 149 THEN 50 ELSE 100 END AS body_score,
  CASE WHEN regexp_matches(combined, {q('(?i)' + alternation(config.ROOT_CAUSE_PHRASES))}) THEN 100 ELSE 0 END AS root_cause,
  CASE WHEN regexp_matches(combined, {q('(?i)' + alternation(config.STEP_PHRASES))}) THEN 100 WHEN lower(state) IN ('closed', 'resolved') THEN 0 ELSE 30 END AS steps_documented,
  CASE WHEN note_count > 0 THEN CAST(noisy AS DOUBLE) / note_count ELSE 0.0 END AS noise_ratio,
  CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(len(list_filter(list_transform(words, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')),
   lambda w: regexp_matches(w, '{_TRIPLE}') OR regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]{{5,}}$') OR (length(w) BETWEEN 3 AND 5 AND NOT regexp_matches(w, '[aeiou]')))) AS DOUBLE) / len(words) END AS odd FROM s0),
s2 AS (SELECT *, CAST(floor(short_score * CAST(0.4 AS DOUBLE) + body_score * CAST(0.6 AS DOUBLE) + 0.5) AS INTEGER) AS description_quality,
  CASE WHEN odd < 0.03 THEN 95 WHEN odd < 0.08 THEN 75 WHEN odd < 0.15 THEN 55 ELSE 30 END AS spelling_grammar,
  CAST(floor(greatest(0.0, 100 - issues * 15 - noise_ratio * 60) + 0.5) AS INTEGER) AS professionalism FROM s1),
s3 AS (SELECT *, CAST(floor(description_quality * CAST(0.25 AS DOUBLE) + root_cause * CAST(0.25 AS DOUBLE) + steps_documented * CAST(0.2 AS DOUBLE) + spelling_grammar * CAST(0.15 AS DOUBLE) + professionalism * CAST(0.15 AS DOUBLE) + 0.5) AS INTEGER) AS total FROM s2),
scored AS (SELECT *, CASE WHEN total >= 80 THEN 'Excellent' WHEN total >= 55 THEN 'Good' WHEN total >= 30 THEN 'Poor' ELSE 'Critical' END AS label,
  list_filter([CASE short_score WHEN 0 THEN 'Short description is missing or too short.' WHEN 40 THEN 'Short description is too vague.' END,
   CASE body_score WHEN 70 THEN 'Description is auto-generated from monitoring alert.' WHEN 0 THEN 'Description is empty or too short.' WHEN 50 THEN 'Description is brief — add more context.' END,
   CASE WHEN root_cause = 0 THEN 'No root cause documented.' END,
   CASE steps_documented WHEN 0 THEN 'Closed without documenting resolution steps.' WHEN 30 THEN 'No resolution steps documented yet.' END,
   CASE spelling_grammar WHEN 55 THEN 'Some spelling issues detected.' WHEN 30 THEN 'Significant spelling issues detected.' END,
   {', '.join(f"CASE WHEN regexp_matches(combined, '{p}') THEN {q(m)} END" for p, m in _SLANG)},
   CASE WHEN note_count = 0 THEN 'No human work notes found.' END], lambda x: x IS NOT NULL) AS feedback FROM s3)"""


def tokens_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({x}), '\\[url\\]', ' ', 'g'), '\\S+@\\S+', ' ', 'g')"
    x = f"list_distinct(regexp_split_to_array(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'))"
    stops = ", ".join(map(q, config.STOP_WORDS))
    return f"list_filter({x}, lambda t: length(t) > 2 AND t NOT IN ({stops}) AND NOT regexp_matches(t, '^[0-9]+$') AND NOT (regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]')))"


def truncate_sql(x: str, most: int) -> str:
    c = trim_sql(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    cut = f"substring({c}, 1, {most})"
    at = f"length(regexp_extract({cut}, '^(.*) ', 1))"
    return f"CASE WHEN length({c}) <= {most} THEN {c} ELSE concat(CASE WHEN {at} > {most} * 0.6 THEN substring({cut}, 1, {at}) ELSE {cut} END, '…') END"


def _category_sql() -> str:
    whens = []
    for column in ("short_desc_clean", "desc_clean"):
        whens += [f"WHEN regexp_matches({column}, {q(f'(?i){chr(92)}b({words}){chr(92)}b')}) THEN {q(name)}" for name, words in config.CATEGORIES]
    return f"CASE {' '.join(whens)} ELSE {q(config.UNCATEGORIZED)} END"


_STRIPPED = trim_sql(r"regexp_replace(" + trim_sql("x") + r", '^[,:;\-\s]+', '')")

ANNOTATED = f"""a0 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(combined, '([.!?;])\\s+', concat('\\1', chr(1)), 'g'), '\\n+', chr(1), 'g'), '(^|\\s)[-•*]\\s+', chr(1), 'g'), chr(1)), lambda x: {_STRIPPED} || CASE WHEN regexp_matches(x, {q('(?i)' + alternation(config.ROOT_CAUSE_PHRASES))}) THEN '' ELSE chr(2) END), lambda x: NOT contains(x, chr(2)) AND length(x) >= 8) AS causes FROM scored),
annotated AS (SELECT * EXCLUDE (service, service_offering, causes, words), {_category_sql()} AS category,
  CASE WHEN len(causes) = 0 THEN '' ELSE {truncate_sql('causes[1]', 180)} END AS root_cause_text,
  CASE WHEN closed <> '' AND closed >= opened THEN CASE WHEN epoch(CAST(closed AS TIMESTAMP) - CAST(opened AS TIMESTAMP)) / 3600.0 <= 8760 THEN epoch(CAST(closed AS TIMESTAMP) - CAST(opened AS TIMESTAMP)) / 3600.0 END END AS resolution_hours,
  strftime(CAST(opened AS TIMESTAMP), '%G-W%V') AS week, substring(opened, 1, 7) AS month, lower(state) LIKE '%closed%' OR lower(state) LIKE '%resolved%' AS is_closed,
  {tokens_sql("CASE WHEN length(" + trim_sql('short_desc_clean') + ") >= 8 THEN short_desc_clean ELSE substring(desc_clean, 1, 200) END")} AS tokens,
  nullif(service, '') AS service, nullif(service_offering, '') AS service_offering FROM a0)"""

PRELUDE = ",\n".join((INCIDENTS, NOTES, SCORED, ANNOTATED))


def sql(select: str, *more: str, prelude: str = PRELUDE) -> str:
    """A statement over the annotated incidents; ``more`` are further common table expressions."""
    return "WITH " + ",\n".join((prelude, *more)) + "\n" + select


def pct_sql(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN floor(CAST({part} AS DOUBLE) / ({whole}) * 100.0 * 10.0 + 0.5) / 10.0 ELSE 0.0 END"


def whole_pct_sql(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN ({whole}) > 0 THEN floor(CAST({part} AS DOUBLE) / ({whole}) * 100.0 + 0.5) ELSE 0 END AS BIGINT)"


def round1_sql(x: str) -> str:
    return f"floor(({x}) * 10.0 + 0.5) / 10.0"


def known_sql(c: str) -> str:
    return f"nullif(trim({c}), '')"
