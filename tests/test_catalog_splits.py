"""Catalog upkeep, split rules and payouts on small frames."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cadenza.operators import catalog, fx, splits
from cadenza.plans import fixtures
from tests.conftest import rows
from tests.test_requests import royalty
from cadenza.schema import STORED_SCHEMA

ITEMS = "owner_user_id string, artist string, album_title string, upc string, isrc string, track_title string"


def upsert(spark, items, state=None):
    state = state or {
        "artists": spark.createDataFrame([], fixtures.EMPTY_ARTISTS),
        "albums": spark.createDataFrame([], fixtures.EMPTY_ALBUMS),
        "tracks": spark.createDataFrame([], fixtures.EMPTY_TRACKS),
    }
    artists = catalog.upsert_artists(items, state["artists"])
    albums = catalog.upsert_albums(items, state["albums"], artists)
    tracks = catalog.upsert_tracks(items, state["tracks"], albums, artists)
    return {"artists": artists, "albums": albums, "tracks": tracks}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            ("o", "Ann", "Disc", "77", "I1", "One"),
            ("o", "Bob", "Disc II", "77", "I1", "Uno"),
            ("o", "Ann", "Loose", None, "I2", "Two"),
            ("o", "Ann", "LOOSE", None, "I3", "Three"),
            ("o", "Ann", None, None, "I1", "Zero"),
            ("p", "Ann", "Disc", "77", "I1", "One"),
        ],
        ITEMS,
    )


def test_items_from_royalties(spark):
    frame = spark.createDataFrame(
        [
            royalty(" I1 ", "One ", "P", "1", artist=" ", album=" ", upc=" 7 "),
            royalty("I1", "One", "Q", "2", artist="", album="", upc="7"),
            royalty("", "One", "P", "1"), royalty("I2", " ", "P", "1"),
        ],
        STORED_SCHEMA,
    )
    assert rows(catalog.catalog_items(frame)) == [("Unknown Artist", None, "7", "I1", "One")]
    assert rows(catalog.catalog_rejects(frame)) == [("blank isrc", 1), ("blank title", 1)]


def test_upsert_rules(spark, items):
    state = upsert(spark, items)
    name = {r["id"]: r["name"] for r in state["artists"].collect()}
    assert sorted(name.values()) == ["Ann", "Ann", "Bob"]
    albums = {
        (r["owner_user_id"], r["title"], r["upc"]): name[r["artist_id"]] for r in state["albums"].collect()
    }
    # Of rivals for one UPC the later artist wins; titles match case-blind.
    assert albums == {("o", "Disc II", "77"): "Bob", ("o", "Loose", None): "Ann", ("p", "Disc", "77"): "Ann"}
    ids = {r["id"]: r["title"] for r in state["albums"].collect()}
    tracks = {
        (r["owner_user_id"], r["isrc"]): (r["title"], name[r["artist_id"]], ids[r["album_id"]])
        for r in state["tracks"].collect()
    }
    assert tracks == {
        ("o", "I1"): ("Uno", "Bob", "Disc II"), ("o", "I2"): ("Two", "Ann", "Loose"),
        ("o", "I3"): ("Three", "Ann", "Loose"), ("p", "I1"): ("One", "Ann", "Disc"),
    }


def test_upsert_twice_is_once(spark, items):
    once = upsert(spark, items)
    twice = upsert(spark, items, once)
    for table in once:
        assert rows(once[table]) == rows(twice[table])


def test_track_keeps_album_when_item_has_none(spark, items):
    state = upsert(spark, items.where("isrc = 'I2'"))
    bare = spark.createDataFrame([("o", "Cat", None, None, "I2", "Deux")], ITEMS)
    after = upsert(spark, bare, state)
    before = state["tracks"].first()
    got = after["tracks"].first()
    assert (got["id"], got["album_id"], got["title"]) == (before["id"], before["album_id"], "Deux")


def test_members_payees_patch_duplicates(spark):
    members = spark.createDataFrame([("w", "a", "Viewer")], "workspace_id string, user_id string, role string")
    changes = spark.createDataFrame([("w", "a", "Admin"), ("w", "b", "Manager")], members.schema)
    assert rows(catalog.upsert_members(changes, members)) == [("w", "a", "Admin"), ("w", "b", "Manager")]
    payees = spark.createDataFrame([("1", "o", "X")], "id string, owner_user_id string, name string")
    more = spark.createDataFrame([("o", "X"), ("o", "Y")], "owner_user_id string, name string")
    key = ["owner_user_id", "name"]
    once = catalog.upsert_named(more, payees, key)
    assert once.count() == 2 and rows(catalog.upsert_named(more, once, key)) == rows(once)
    patched = catalog.patch(
        payees, spark.createDataFrame([("1", None, "Z")], "id string, owner_user_id string, name string"),
        ["owner_user_id", "name"],
    )
    assert rows(patched) == [("1", "o", "Z")]
    assert rows(catalog.duplicate_keys(once.unionByName(payees), key)) == [("o", "X", 2)]
    assert catalog.blank_names(spark.createDataFrame([("  ",), ("x",), (None,)], "name string"), "name").count() == 2


RULE = (
    "id string, workspace_id string, artist_id string, album_id string, track_id string, payee_id string, "
    "payee_name string, percentage decimal(5,2), effective_from date, effective_to date"
)


def rule(id_, pct, payee="P", artist=None, album=None, track=None, start=None, end=None):
    def day(text):
        return text and dt.date.fromisoformat(text)

    return (id_, "w", artist, album, track, payee, payee, D(pct), day(start), day(end))


def test_deletes(spark):
    frames = {
        "artists": spark.createDataFrame([("a1", "o", "A"), ("a2", "o", "B")], fixtures.EMPTY_ARTISTS),
        "albums": spark.createDataFrame(
            [("b1", "o", "a1", "X", None, None), ("b2", "o", "a2", "Y", None, None)], fixtures.EMPTY_ALBUMS
        ),
        "tracks": spark.createDataFrame(
            [("t1", "o", "a1", "b1", "I1", "T"), ("t2", "o", "a2", "b1", "I2", "T"), ("t3", "o", "a2", None, "I3", "T")],
            fixtures.EMPTY_TRACKS,
        ),
        "splits": spark.createDataFrame(
            [rule("s1", "1", artist="a1"), rule("s2", "1", album="b1"), rule("s3", "1", track="t1"),
             rule("s4", "1", track="t2"), rule("s5", "1")],
            RULE,
        ),
    }
    gone = spark.createDataFrame([("a1",)], "id string")
    rest = catalog.delete_artists(gone, frames)
    assert rows(rest["artists"].select("id")) == [("a2",)]
    assert rows(rest["albums"].select("id")) == [("b2",)]
    assert rows(rest["tracks"].select("id", "album_id")) == [("t2", None), ("t3", None)]
    assert rows(rest["splits"].select("id")) == [("s4",), ("s5",)]
    named = spark.createDataFrame([("P",), ("Q",)], "id string")
    assert rows(catalog.payees_in_use(named, frames["splits"])) == [("P",)]


def test_violations_and_totals(spark):
    rules = [
        rule("ok", "50", track="t1", start="2024-01-01", end="2024-01-31"),
        rule("ok2", "60", track="t1", start="2024-02-01"),
        rule("none", "5"), rule("two", "5", track="t9", album="b9"), rule("low", "0", track="t2"),
        rule("late", "5", track="t3", start="2024-02-01", end="2024-01-01"),
        rule("blank", "5", payee=" ", track="t4"), rule("big", "100.01", track="t5"),
        *[rule(f"m{i}", "0.01", payee=f"P{i}", artist="a1") for i in range(51)],
    ]
    frame = spark.createDataFrame(rules, RULE)
    got = {(r["subject"], r["reason"]) for r in splits.split_violations(frame).collect()}
    assert got == {
        ("none", "not exactly one target"), ("two", "not exactly one target"),
        ("low", "percentage out of range"), ("big", "percentage out of range"),
        ("late", "ends before it starts"), ("blank", "blank payee"),
        ("t1", "total over 100"), ("t5", "total over 100"), ("a1", "too many payees"),
    }
    totals = {r["target_id"]: (r["total"], r["peak"], r["over"]) for r in splits.split_totals(frame).collect()}
    assert totals["t1"] == (D("110.00"), D("60.00"), True)


def test_effective_rules(spark):
    frame = spark.createDataFrame(
        [rule("open", "1"), rule("past", "1", end="2024-01-01"), rule("edge", "1", start="2024-06-01", end="2024-06-01")],
        RULE,
    )
    assert rows(splits.effective_splits(frame, "2024-06-01", "w").select("id")) == [("edge",), ("open",)]
    assert splits.effective_splits(frame, "2024-06-01", "other").count() == 0


def test_payouts_against_a_loop(spark):
    """Random rules and royalties; each row's payouts add up to its revenue."""
    rng = random.Random(3)
    day = dt.date(2024, 1, 1)
    tracks = [(f"t{i}", "o", f"a{i % 3}", f"b{i % 4}" if i % 5 else None, f"I{i}", "T") for i in range(12)]
    rules = []
    for i in range(60):
        kind = rng.choice(["track", "album", "artist", None])
        target = {"track": f"t{rng.randrange(12)}", "album": f"b{rng.randrange(4)}", "artist": f"a{rng.randrange(2)}"}
        start = rng.choice([None, day + dt.timedelta(rng.randrange(60))])
        end = rng.choice([None, (start or day) + dt.timedelta(rng.randrange(40))])
        named = {kind: target[kind]} if kind else {}
        pct = "1.25" if kind is None else f"{rng.randrange(1, 6000) / 100:.2f}"
        rules.append(rule(f"r{i}", pct, f"P{rng.randrange(9)}", start=start and str(start), end=end and str(end), **named))
    facts = [
        royalty(f"I{rng.randrange(14)}", "T", "P", f"{rng.randrange(-10**12, 10**12)}E-9",
                day=str(day + dt.timedelta(rng.randrange(90))))
        for _ in range(300)
    ]
    where = {t[4]: (t[0], t[3], t[2]) for t in tracks}
    want = []
    for f in facts:
        isrc, when, revenue = f[0], f[8], f[9]
        live = [r for r in rules if (r[8] or day) <= when <= (r[9] or dt.date(2099, 1, 1))]
        found = []
        if isrc in where:
            track, album, artist = where[isrc]
            for level, match in (
                ("track", [r for r in live if r[4] == track]),
                ("album", [r for r in live if r[3] is not None and r[3] == album]),
                ("artist", [r for r in live if r[2] == artist]),
                ("workspace", [r for r in live if r[2] is r[3] is r[4] is None]),
            ):
                if match:
                    found = [(level, r[6], r[7]) for r in match]
                    break
        paid = [
            (level, payee, pct, (revenue * pct / 100).quantize(D("1E-9"), ROUND_HALF_UP))
            for level, payee, pct in found
        ]
        rest = revenue - sum((p[3] for p in paid), D(0))
        want += [(isrc, when, revenue, *p) for p in [*paid, (None, "UNALLOCATED", None, rest)]]
    frame = spark.createDataFrame(facts, STORED_SCHEMA)
    track_frame = spark.createDataFrame(tracks, fixtures.EMPTY_TRACKS)
    rule_frame = spark.createDataFrame(rules, RULE)
    got = splits.payout_cascade(frame.select("isrc", "reporting_date", "net_revenue"), track_frame, rule_frame)

    def key(r):
        return repr(tuple(format(v, ".9f") if isinstance(v, D) else v for v in r))

    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(key(r) for r in want)
    totals = splits.payout_by_payee(frame, track_frame, rule_frame).agg(F.sum("amount")).first()[0]
    assert totals == sum(f[9] for f in facts)


def test_fx(spark):
    frame = spark.createDataFrame(
        [royalty("I1", "T", "P", "10", day="2024-01-03", currency="EUR"),
         royalty("I2", "T", "P", "10", day="2024-01-05", currency="EUR"),
         royalty("I3", "T", "P", "10", day="2023-12-31", currency="EUR"),
         royalty("I4", "T", "P", "10", day="2024-01-05")],
        STORED_SCHEMA,
    )
    rates = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "EUR", D("1.1")), (dt.date(2024, 1, 5), "EUR", D("1.2"))],
        "date date, currency_code string, rate_to_usd decimal(10,6)",
    )
    exact = fx.convert_exact(frame, rates).select("isrc", "net_revenue_usd")
    assert rows(exact) == [("I1", None), ("I2", D("12.000000000")), ("I3", None), ("I4", D("10.000000000"))]
    as_of = fx.convert_as_of(frame, rates).select("isrc", "net_revenue_usd")
    assert rows(as_of)[0] == ("I1", D("11.000000000")) and rows(as_of)[2] == ("I3", None)
    assert rows(fx.missing_rates(frame, rates).select("reporting_date")) == [
        (dt.date(2023, 12, 31),), (dt.date(2024, 1, 3),)
    ]


def test_catalog_join_and_orphans(spark):
    frame = spark.createDataFrame([royalty("I1", "T", "P", "1"), royalty("I9", "T", "P", "1")], STORED_SCHEMA)
    artists = spark.createDataFrame([("a1", "o", "A")], fixtures.EMPTY_ARTISTS)
    albums = spark.createDataFrame([], fixtures.EMPTY_ALBUMS)
    tracks = spark.createDataFrame([("t1", "o", "a1", None, "I1", "T"), ("t2", "o", "a1", None, "I2", "T")], fixtures.EMPTY_TRACKS)
    got = splits.with_catalog(frame, tracks, albums, artists).select("isrc", "track_id", "artist_name", "album_title")
    assert rows(got) == [("I1", "t1", "A", None), ("I9", None, None, None)]
    assert rows(splits.orphans(frame, tracks)) == [("I2", "no royalties"), ("I9", "no track")]
