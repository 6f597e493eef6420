"""What plans must look like to hold on large and uneven data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadenza.operators import catalog, joins, quantile, splits
from cadenza.operators.ordered import busy_keys
from cadenza.plans import QUERIES, fixtures, royalty, upkeep
from cadenza.session import configure, staged
from cadenza.sources import clustered
from tests.conftest import SF, rows


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    """Settings under which a hot key of test size counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "64",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_isrc_is_split_and_paid_alike(spark, small_partitions, monkeypatch):
    frames = fixtures.label_catalog(spark, SF)
    isrc = F.when(F.col("platform") < "3", "US0000000007").otherwise(F.col("isrc"))
    hot = fixtures.royalties(spark, SF).withColumn("isrc", isrc)
    hot = staged(hot.select("isrc", "reporting_date", "net_revenue").repartition(16))
    want = rows(splits.payout_by_payee(hot, frames["tracks"], frames["splits"]))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    shuffled = splits.payout_by_payee(hot, frames["tracks"], frames["splits"])
    assert rows(shuffled) == want
    assert "SortMergeJoin(skew=true)" in plan(shuffled)


def test_lookups_are_broadcast_only_when_small(spark, monkeypatch):
    table = spark.range(100)
    big = spark.range(10**6).withColumnRenamed("id", "key")
    assert "BroadcastHashJoin" in plan(big.join(joins.lookup(table, 8), F.expr("id = key")))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 99)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(big.join(joins.lookup(table, 8), F.expr("id = key")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["distinct_on", "ev_dedup", "ev_rate_limit"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["limit_default", "sort_dims", "top_track", "page_desc"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, SF))


def test_no_plan_pairs_all_rows_or_leaves_the_jvm(spark):
    python = {"ev_batch", "ev_debounce_cap", "ev_singleton_skip"}
    for name, query in QUERIES.items():  # the training-data operators have tests of their own
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert ("MapInPandas" in text) == (name in python), name


def test_scan_reads_only_what_a_query_needs(spark):
    text = plan(entry.queries()["agg_multi_dim"](spark, SF))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    wide = [s for s in scans if "l_comment" in s or "l_tax" in s or "o_totalprice" in s]
    assert len(scans) == 6 and not wide


def test_busy_keys(spark):
    frame = spark.createDataFrame([(1,)] * 5 + [(None,)] * 4 + [(2,)], "k int")
    assert rows(busy_keys(frame, ["k"], 3)) == [(1,), (None,)]
    assert busy_keys(frame, ["k"], 10) is None


def counted(spark, frame):
    """The frame, and an accumulator of how many of its rows have been worked out."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(note, frame.schema), seen


def test_lines_are_joined_with_orders_that_have_their_customer(spark, monkeypatch):
    assert fixtures._is_small(spark, SF, "orders")
    monkeypatch.setattr(fixtures, "_SMALL", {f"{SF}/orders.parquet": False})
    text = fixtures.royalties(spark, SF, "dataset_id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Inner, (l_orderkey") < text.index("Inner, (o_custkey")  # the outer join comes first
    assert text.index("Inner, (l_orderkey") < text.index("c_nationkey")


def test_percentiles_and_clustered_files_work_their_rows_out_once(spark, tmp_path):
    frame = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "cast(pmod(hash(id), 1000) as double) AS v", "cast(id as string) AS s")
    rows_, seen = counted(spark, frame)
    got = quantile.exact_percentiles(rows_, ["k"], "v", {"middle": 0.5, "high": 0.99}, held=50)
    want = frame.groupBy("k").agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.99)))
    assert rows(got) == rows(want) and seen.value == 3000
    rows_, seen = counted(spark, frame)
    clustered.write_clustered(rows_, str(tmp_path / "c"), ["v", "s"], 2)
    assert seen.value == 3000
    assert rows(clustered.read_clustered(spark, str(tmp_path / "c"), {"v": (10.0, 20.0)})) == rows(frame.where("v between 10 and 20"))


def test_clustered_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "FILE_ROWS", 100)
    frame = spark.range(1000).selectExpr("id", "id % 7 AS g")
    clustered.write_clustered(frame, str(tmp_path), ["id", "g"], 2)
    assert spark.read.parquet(f"{tmp_path}/bounds").count() == 10
    assert rows(spark.read.parquet(f"{tmp_path}/rows").select("id", "g")) == rows(frame)


@pytest.mark.parametrize("name", ["summary_incremental", "upsert_tracks"])
def test_royalties_are_worked_out_once(spark, monkeypatch, name):
    made = fixtures.royalties(spark, SF, "dataset_id", "owner_user_id")
    frame, seen = counted(spark, staged(made))
    want = rows(entry.queries()[name](spark, SF))
    for module in (fixtures, royalty, upkeep):
        monkeypatch.setattr(module, "royalties", lambda *a, **b: frame)
    assert rows(entry.queries()[name](spark, SF)) == want
    assert seen.value == made.count()


def test_catalog_jobs_take_repeated_facts(spark):
    facts = catalog.catalog_facts(fixtures.royalties(spark, SF, "owner_user_id"))
    facts, items = staged(facts.unionByName(facts)), staged(facts.distinct())
    artists, albums = (spark.createDataFrame([], s) for s in (fixtures.EMPTY_ARTISTS, fixtures.EMPTY_ALBUMS))
    named = [catalog.upsert_artists(f, artists) for f in (facts, items)]
    assert rows(named[0]) == rows(named[1])
    titled = [catalog.upsert_albums(f, albums, named[0]) for f in (facts.drop("isrc", "track_title"), items)]
    assert rows(titled[0]) == rows(titled[1])


def test_tasks_are_small_unless_the_user_says_otherwise(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert configure(spark).conf.get(key) == "16MB"
        spark.conf.set(key, "40MB")
        assert configure(spark).conf.get(key) == "40MB"
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
