"""Queries against their SQL. All of them run in full by the driver; here a cross-section, or all with ALL_QUERIES=1."""

import os

import duckdb
import pytest

from ticketlens.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SOME = ["incidents", "scores", "annotated", "overview", "trends_by_week", "problem_table", "recommend", "cross_tab", "candidate_context", "category_movements", "week_problems", "profile_fields", "executive_metrics", "family_text_r2", "families", "template_grams", "family_rows", "family_cards", "family_partitions", "family_representatives", "service_ranking", "typed_cells"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "events", "orders", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("ALL_QUERIES") else SOME)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    done = duck.execute(SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in done.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 90


def test_filters_do_not_recluster_and_close_on_the_total(spark):
    from ticketlens.operators import origin as O
    from ticketlens.plans.filters import Filters, Selection, filtered
    from ticketlens.sources.view import tickets

    t = tickets(spark, SF).select("row_id", "month", "service", "service_offering", "assignment_group", "category").cache()
    a, b = Filters(months=("2024-01",)), Filters(service=Selection(("en",), True))
    ids = lambda f: {r.row_id for r in filtered(t, f).select("row_id").collect()}
    assert ids(Filters(months=("2024-01",), service=Selection(("en",), True))) == ids(a) & ids(b)
    table = O.dimension_table(t, "offering", "category")
    shown = O.top_with_others(table, 4).agg({"n": "sum"}).first()[0]
    assert shown == t.count() == O.cross_tab(t, "service", "group").filter("level = 3").first().n
    assert Selection(("x",)).toggle("x").active is False and Selection().toggle_missing().active


def test_every_part_of_the_weekly_digest_is_in_its_table(spark):
    digest = QUERIES["week_digest"](spark, SF).collect()
    section = lambda name: [(r["rank"], r["name"], r["n"]) for r in sorted(digest, key=lambda r: r["rank"]) if r.section == name]
    week = [r for r in QUERIES["week_problems"](spark, SF).collect() if r.week == "2024-W09"]
    for kind in ("new", "recurring"):
        assert section(kind) == sorted((r["rank"], r.category, r.n) for r in week if r.kind == kind)
    assert section("top") == sorted((r["rank"], r.category, r.n) for r in QUERIES["week_top_problems"](spark, SF).collect() if r.week == "2024-W09")
    assert {x[1:] for x in section("actions")} == {(r.category, r.n) for r in QUERIES["week_actions"](spark, SF).collect()}
    assert section("movements") == sorted((r["rank"], r["name"], r.n) for r in QUERIES["category_movements"](spark, SF).collect() if r.week == "2024-W09")
    assert section("volume") == [(1, r.week, r.n) for r in QUERIES["weekly_volumes"](spark, SF).collect() if r.week == "2024-W09"]


def test_rewritten_input_gives_new_answers(spark, tmp_path):
    for t in ("events", "orders", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (20, 9):
        docs.filter(f"doc_id < {rows}").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert QUERIES["overview"](spark, str(tmp_path)).first().total == rows


def test_clustered_queries_against_sequential_clusters_and_sql(spark, duck):
    """The statements, which have the category as key, over the clusters that the row-by-row rule gives."""
    from test_cluster import sequential

    from ticketlens.plans.catalog import ticket_table
    from ticketlens.plans.oracle import PRELUDE

    rows = [(r.row_id, r.category, r.tokens) for r in ticket_table(spark, SF).select("row_id", "category", "tokens").orderBy("row_id").collect()]
    duck.execute("CREATE OR REPLACE TABLE clusters (row_id BIGINT, cluster_id VARCHAR)")
    duck.executemany("INSERT INTO clusters VALUES (?, ?)", list(sequential(rows).items()))
    renamed = PRELUDE.replace("annotated AS (", "annotated0 AS (", 1) + ",\nannotated AS (SELECT a.* EXCLUDE (category), c.cluster_id AS category FROM annotated0 a JOIN clusters c USING (row_id))"
    for name, base, columns in (
        ("clustered_problems", "problem_sheet", ["title", "n", "rca_coverage", "root_causes", "top_groups", "sample_numbers"]),
        ("clustered_week_problems", "week_problems", ["week", "kind", "rank", "n", "weeks_active", "is_chronic"]),
        ("clustered_actions", "recommend", ["kind", "n", "priority"]),
    ):
        got = plain(QUERIES[name](spark, SF).select("cluster_id", *columns).collect())
        want = plain(duck.execute(f"SELECT category, {', '.join(columns)} FROM ({SQL[base].replace(PRELUDE, renamed)})").fetchall())
        assert got == want and got, name
