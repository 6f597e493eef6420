"""Structured requests, pages, summaries and plain SQL."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cadenza.operators import access, history, paging, summary
from cadenza.operators.access import effective_role
from cadenza.operators.catalog import patch, upsert_members
from cadenza.operators.paging import page
from cadenza.operators.sqlrun import run_sql
from cadenza.operators.structured import structured_query
from cadenza.operators.windows import distinct_on, over_groups
from cadenza.schema import STORED_SCHEMA, RequestError
from tests.conftest import by_name, rows


def royalty(isrc, title, platform, revenue, quantity=1, day="2024-01-05", dataset="d1", **more):
    row = {
        "isrc": isrc, "upc": "", "title": title, "artist": "A", "album": "", "platform": platform,
        "territory": "NG", "transaction_type": "", "reporting_date": dt.date.fromisoformat(day),
        "net_revenue": D(revenue), "currency": "USD", "quantity": quantity, "dataset_id": dataset,
    }
    return tuple({**row, **more}[c] for c in STORED_SCHEMA.fieldNames())


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(
        [
            royalty("I1", "One", "Spotify", "1.5", 3),
            royalty("I2", "One", "Deezer", "2.5", 4, day="2024-02-01"),
            royalty("I3", "it's", "Deezer", "-1", 5, day="2024-03-01", dataset="d2"),
            royalty("I3", "it's", "Deezer", "-1", 5, day="2024-03-01", dataset="d2"),
        ],
        STORED_SCHEMA,
    )


def test_empty_request_gives_all_columns(data):
    assert structured_query(data).columns == STORED_SCHEMA.fieldNames()[:-1]
    assert structured_query(data).count() == 4


def test_metrics_decide_the_shape(data):
    assert structured_query(data, ["platform"]).count() == 4
    assert structured_query(data, ["platform"], []).count() == 2
    assert rows(structured_query(data, ["platform"], ["quantity"])) == [("Deezer", 14), ("Spotify", 3)]
    assert by_name(structured_query(data, metrics=["net_revenue", "quantity"])) == [
        {"total_revenue": D("2"), "total_streams": 17}
    ]


def test_default_limit(spark):
    many = spark.range(250).select(F.col("id").cast("string").alias("isrc"))
    assert structured_query(many, ["isrc"]).count() == 100
    assert structured_query(many, ["isrc"], limit=None).count() == 250


def test_filters(data):
    def count(field, operator, value):
        found = [{"field": field, "operator": operator, "value": value}]
        return structured_query(data, filters=found).count()

    assert count("title", "eq", "it's") == 2
    assert count("title", "eq", "' OR 1=1 --") == 0
    assert count("title", "in", ["One", "it's"]) == 4
    assert count("title", "in", "One") == 2
    assert count("title", "like", "one") == 0
    assert count("title", "like", "O%") == 2
    assert count("country", "eq", "NG") == 4
    assert count("reporting_date", "gte", "2024-02-01") == 3
    assert count("platform", "ne", "Deezer") == 1
    assert structured_query(data, where="net_revenue < 0 OR quantity = 3").count() == 3


def test_dates_datasets_and_country(data):
    got = structured_query(
        data, ["country", "platform"], ["quantity"],
        date_range={"from": "2024-01-05", "to": "2024-02-01"}, dataset_ids=["d1"],
    )
    assert got.columns == ["country", "platform", "total_streams"]
    assert rows(got) == [("NG", "Deezer", 4), ("NG", "Spotify", 3)]


@pytest.mark.parametrize(
    "request_,message",
    [
        ({"dimensions": ["payee"]}, "Dimension 'payee' is not allowed"),
        ({"metrics": ["clicks"]}, "Metric 'clicks' is not supported"),
        ({"filters": [{"field": "quantity", "operator": "eq", "value": "1"}]}, "Filter field"),
        ({"filters": [{"field": "isrc", "operator": "near", "value": "1"}]}, "Filter operator"),
    ],
)
def test_refusals(data, request_, message):
    with pytest.raises(RequestError, match=message):
        structured_query(data, **request_)


def test_filters_and_columns_reach_the_scan(spark, data, tmp_path):
    data.write.partitionBy("dataset_id").parquet(str(tmp_path / "t"))
    stored = spark.read.schema(STORED_SCHEMA).parquet(str(tmp_path / "t"))
    got = structured_query(
        stored, ["platform"], ["quantity"], date_range={"from": "2024-02-01"}, dataset_ids=["d2"],
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(reporting_date,2024-02-01)" in plan
    assert "ReadSchema: struct<platform:string,reporting_date:date,quantity:bigint>" in plan
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_summary(data, spark):
    full = by_name(summary.summary(data))[0]
    assert full == {
        "total_net_revenue": 2.0, "total_streams": 17, "top_artist": "A", "top_platform": "Spotify",
        "top_track": "One", "total_tracks_monetized": 3,
    }
    empty = by_name(summary.summary(spark.createDataFrame([], STORED_SCHEMA)))[0]
    assert empty["total_net_revenue"] == 0.0 and empty["top_artist"] is None
    assert by_name(summary.kpis(data))[0]["total_tracks_monetized"] == 3


def test_pages(spark):
    day = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame(
        [(f"i{n}", day + dt.timedelta(days=n // 2)) for n in range(10)], "id string, created_at timestamp_ntz"
    )
    seen, cursor = [], None
    while True:
        fetched = paging.page(items, cursor, 3)
        meta = by_name(paging.page_meta(fetched, 3))[0]
        seen += [r["id"] for r in paging.page_rows(fetched, 3).collect()]
        if not meta["has_more"]:
            assert meta["next_cursor"] is None
            break
        cursor = meta["next_cursor"]
    assert seen == [f"i{n}" for n in reversed(range(10))]
    assert paging.page(items, "unknown", 3).count() == 0
    assert [paging.page_size(x) for x in (None, 0, 7, 1000)] == [50, 1, 7, 100]


def test_sql_runs_queries_only(spark, data):
    tables = {"royalty_data": lambda child: child.createDataFrame([("I1", 7)], "isrc string, quantity int")}
    got = run_sql(spark, 'WITH q AS (SELECT isrc AS "the id", quantity FROM royalty_data) '
                         'SELECT * FROM q ORDER BY quantity -- end', tables)
    assert by_name(got) == [{"the id": "I1", "quantity": 7}]
    for text in (
        "DROP VIEW royalty_data", "CREATE TABLE x AS SELECT 1", "SET a=b", "SELECT 1; SELECT 2",
        "INSERT INTO royalty_data VALUES ('x', 1)", "CACHE TABLE royalty_data", "SELECT nothing FROM royalty_data",
    ):
        with pytest.raises(RequestError):
            run_sql(spark, text, tables)
    assert not [t for t in spark.catalog.listTables() if t.name == "royalty_data"]


def test_renamed_functions(spark):
    row = run_sql(
        spark,
        "SELECT gcd(12, 18) g, gcd(0, 5) g0, lcm(4, 6) l, lcm(0, 3) l0, to_hex(255) h, strpos('abc', 'c') s, "
        "array_to_string(string_to_array('a.b', '.'), '-') a, iszero(0) z, starts_with('ab', 'a') w, "
        "substr_index('a.b.c', '.', 2) x, regexp_match('ab12', '[0-9]+')[0] r, hex(sha256('')) d",
        {},
    ).first()
    assert (row.g, row.g0, row.l, row.l0, row.h, row.s) == (6, 5, 12, 0, "ff", 3)
    assert (row.a, row.z, row.w, row.x, row.r) == ("a-b", True, True, "a.b", "12")
    assert row.d.startswith("E3B0C442")


def test_windows(spark):
    frame = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 2, 5), ("a", 4, 1)], "k string, o int, v int")
    got = over_groups(frame, lambda: F.sum("v"), ["k"], "o", 1, 0, "s")
    assert rows(got.select("o", "v", "s")) == [(1, 10, 30), (1, 20, 30), (2, 5, 35), (4, 1, 6)]
    assert rows(distinct_on(frame, ["k"], [F.desc("v")]).select("v")) == [(20,)]


def test_history_and_roles(spark):
    day = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("w", "u", "SELECT 1", 1, 5, day), ("w", "u", "SELECT 1", 2, 5, day + dt.timedelta(1)),
         ("w", "u", "SELECT 2", 3, 5, day)],
        "workspace_id string, user_id string, sql_executed string, row_count int, execution_time_ms int, created_at timestamp_ntz",
    )
    records = history.history_records(runs)
    assert records.select("query_id").distinct().count() == 2
    assert rows(history.latest_by_query_id(records).select("sql_executed", "row_count")) == [
        ("SELECT 1", 2), ("SELECT 2", 3)
    ]
    again = history.rerun(records, "w", records.where("row_count = 3").first()["query_id"], {})
    assert rows(again) == [(2,)]
    with pytest.raises(RequestError, match="not in the history"):
        history.rerun(records, "x", "q_0", {})
    requests = spark.createDataFrame(
        [("w", "own", "Owner"), ("w", "view", "Manager"), ("w", "adm", "Manager"), ("w", "odd", "Viewer"),
         ("w", "none", "Viewer"), ("x", "own", "Viewer")],
        "workspace_id string, user_id string, required_role string",
    )
    workspaces = spark.createDataFrame([("w", "own")], "workspace_id string, owner_user_id string")
    members = spark.createDataFrame(
        [("w", "view", "Viewer"), ("w", "adm", "admin"), ("w", "odd", "Guest")],
        "workspace_id string, user_id string, role string",
    )
    got = access.effective_role(requests, workspaces, members)
    assert rows(got.select("workspace_id", "user_id", "role", "outcome")) == [
        ("w", "adm", "Admin", "granted"), ("w", "none", None, "not a member"),
        ("w", "odd", "Viewer", "granted"), ("w", "own", "Owner", "granted"),
        ("w", "view", "Viewer", "forbidden"), ("x", "own", None, "no workspace"),
    ]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT /* x */ ReFlect('java.lang.System', 'currentTimeMillis') FROM t",
        "SELECT * FROM t WHERE x IN (SELECT z FROM hidden)",
        "SELECT (SELECT max(v) FROM hidden) FROM t",
        "WITH a AS (SELECT * FROM hidden) SELECT * FROM a",
        "SELECT sum(x) OVER (ORDER BY java_method('a', 'b')) FROM t",
        "SELECT * FROM t, LATERAL (SELECT try_reflect('java.lang.Math', 'abs', x))",
    ],
)
def test_sql_stays_with_its_tables(spark, sql):
    spark.range(3).createOrReplaceTempView("hidden")
    with pytest.raises(RequestError):
        run_sql(spark, sql, {"t": lambda s: s.range(3).toDF("x")})


def test_sql_uses_its_own_named_queries(spark):
    got = run_sql(spark, "WITH q AS (SELECT 1 z) SELECT x FROM t WHERE x IN (SELECT z FROM q)", {"t": lambda s: s.range(3).toDF("x")})
    assert rows(got) == [(1,)]


def test_expressions_stay_inside(spark):
    frame = spark.createDataFrame([], STORED_SCHEMA)
    for text in ("reflect('java.lang.System', 'currentTimeMillis') > 0", "isrc IN (SELECT x FROM hidden)"):
        with pytest.raises(RequestError):
            structured_query(frame, ["isrc"], where=text)
        with pytest.raises(RequestError):
            structured_query(frame, ["isrc"], transform={"more": text})


def test_malformed_cursor_is_the_first_page(spark):
    listed = spark.createDataFrame([("id-1", 1), ("id-2", 2)], "id string, created_at int")
    assert page(listed, "???", well_formed=r"id-\d+").count() == 2
    assert page(listed, "id-9", well_formed=r"id-\d+").count() == 0


def test_unknown_required_role_is_forbidden(spark):
    asked = spark.createDataFrame([("w", "u", "Overlord"), ("w", "u", "viewer")], "workspace_id string, user_id string, required_role string")
    spaces = spark.createDataFrame([("w", "u")], "workspace_id string, owner_user_id string")
    none = spark.createDataFrame([], "workspace_id string, user_id string, role string")
    assert {r["required_role"]: r["outcome"] for r in effective_role(asked, spaces, none).collect()} == {"Overlord": "forbidden", "viewer": "granted"}


def test_rival_changes_do_not_multiply_rows(spark):
    listed = spark.createDataFrame([("a", "x", "y")], "id string, n string, m string")
    twice = spark.createDataFrame([("a", "p", None), ("a", None, "q")], "id string, n string, m string")
    assert rows(patch(listed, twice, ["n", "m"])) == [("a", "p", "q")]
    changes = spark.createDataFrame([("w", "u", "Viewer", 2), ("w", "u", "Owner", 1)], "workspace_id string, user_id string, role string, changed_at int")
    none = spark.createDataFrame([], "workspace_id string, user_id string, role string")
    assert rows(upsert_members(changes, none)) == [("w", "u", "Viewer")]
    assert rows(upsert_members(changes.drop("changed_at"), none)) == [("w", "u", "Viewer")]


def test_quoted_names_on_every_kind_of_table(spark, tmp_path):
    """What a parser takes for a name must not depend on the session that is active."""
    spark.range(3).toDF("x").write.parquet(str(tmp_path / "t"))
    sources = [lambda s: s.range(3).toDF("x"), lambda s: s.read.parquet(str(tmp_path / "t")), lambda s: s.createDataFrame([(0,), (1,), (2,)], "x long")]
    for first in sources:
        for source in (first, *sources):
            got = run_sql(spark, 'SELECT x AS "the id", \'it\' AS said FROM t WHERE "x" > 0', {"t": source})
            assert got.columns == ["the id", "said"] and rows(got) == [(1, "it"), (2, "it")]
    assert spark.sql("SELECT \"text\" AS t").first()["t"] == "text"


def test_date_bin_takes_intervals_and_seconds(spark):
    got = run_sql(spark, "SELECT date_bin(INTERVAL '15 minutes', TIMESTAMP'2024-01-01 00:25:00', TIMESTAMP'2024-01-01 00:00:00') a, "
                  "date_bin(900, TIMESTAMP'2023-12-31 23:59:00', TIMESTAMP'2024-01-01 00:00:00') b", {}).first()
    assert (got["a"], got["b"]) == (dt.datetime(2024, 1, 1, 0, 15), dt.datetime(2023, 12, 31, 23, 45))
    with pytest.raises(RequestError):
        run_sql(spark, "SELECT date_bin(INTERVAL '1' MONTH, TIMESTAMP'2024-01-01 00:25:00') a", {})


def test_distinct_counts_beside_sketches_keep_them_per_group(spark):
    def source(s):
        made = s.range(1000).selectExpr("id % 3 AS g", "IF(id % 5 = 0, NULL, concat('ü', id % 40)) AS x", "IF(id % 7 = 0, NULL, id) AS y", "id % 50 AS q")
        return made.repartition(4)

    text = """SELECT g, 'ü)' AS said, count(DISTINCT x) AS n, count(distinct x, (y % 4)) + sum(DISTINCT y % 9) AS m, approx_median(q) AS mid
      FROM t WHERE q >= (SELECT count(DISTINCT g) - 3 FROM t) GROUP BY g HAVING count(DISTINCT x) > 1"""
    for query in (text, text.replace("count(distinct x, (y % 4)) + sum(DISTINCT y % 9)", "0")):
        got = run_sql(spark, query, {"t": source})
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" in plan  # sketches are in the rows of the plain group only, not in those of a group and a value
        source(spark).createOrReplaceTempView("plain_t")
        plain = query.replace("FROM t", "FROM plain_t").replace("approx_median(q)", "median(q)")
        assert rows(got) == rows(spark.sql(plain))
    alone = run_sql(spark, "SELECT g, count(DISTINCT x) AS n, max(q) AS most FROM t GROUP BY g", {"t": source})
    assert "Expand" not in alone._jdf.queryExecution().optimizedPlan().toString()
