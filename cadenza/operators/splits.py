"""Payee split rules and payouts.

A rule names at most one target: a track, an album, an artist, or none (the
whole workspace). It is live on a date inside its validity; open ends reach
from 1900-01-01 to 2099-12-31. A royalty row is paid by the live rules of its
most specific target: track before album before artist before workspace. Each
payee's amount is rounded half up to nine places and `UNALLOCATED` gets the
rest, so a row's payouts always add up to its revenue. Targets promised more
than 100 percent are paid as written and leave a negative remainder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.cleaning import blank
from cadenza.operators.catalog import OWNER
from cadenza.operators.joins import lookup
from cadenza.schema import AMOUNT, MONEY, PERCENT

# Open validity ends, percentage bounds, payees per target.
OPEN_FROM, OPEN_TO = "1900-01-01", "2099-12-31"
MIN_PERCENT, MAX_PERCENT = "0.01", "100.00"
MAX_PAYEES = 50

TARGETS = ("track_id", "album_id", "artist_id")
LEVELS = ("track", "album", "artist", "workspace")
UNALLOCATED = "UNALLOCATED"


def _from(prefix: str = "") -> Column:
    return F.coalesce(F.col(prefix + "effective_from"), F.lit(OPEN_FROM).cast("date"))


def _to(prefix: str = "") -> Column:
    return F.coalesce(F.col(prefix + "effective_to"), F.lit(OPEN_TO).cast("date"))


def effective_splits(rules: DataFrame, on: str | Column, workspace_id: str | None = None) -> DataFrame:
    """Rules live on a date, of one workspace if given."""
    day = F.lit(on).cast("date") if isinstance(on, str) else on
    own = rules if workspace_id is None else rules.where(F.col("workspace_id") == workspace_id)
    return own.where((_from() <= day) & (_to() >= day))


def splits_for_target(
    rules: DataFrame,
    workspace_id: str,
    track_id: str | None = None,
    album_id: str | None = None,
    artist_id: str | None = None,
) -> DataFrame:
    """Rules of a workspace for any subset of targets; none given means any."""
    found = rules.where(F.col("workspace_id") == workspace_id)
    for column, value in zip(TARGETS, (track_id, album_id, artist_id)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def with_target(rules: DataFrame) -> DataFrame:
    """Rules with `target_kind` and `target_id`; a workspace rule targets the workspace."""
    kind, target = F.lit("workspace"), F.col("workspace_id")
    for column, level in reversed(list(zip(TARGETS, LEVELS))):
        kind = F.when(F.col(column).isNotNull(), level).otherwise(kind)
        target = F.coalesce(F.col(column), target)
    return rules.withColumns({"target_kind": kind, "target_id": target})


TARGET_KEY = ["workspace_id", "target_kind", "target_id"]


def split_totals(rules: DataFrame) -> DataFrame:
    """What each target promises: in all, and at most on any one day.

    `total` ignores validity dates, as the rule check does; `peak` is the
    greatest sum of rules live together, from a running sum over the days on
    which rules start and stop. Starts and stops are summed per day first.
    """
    targeted = with_target(rules)
    totals = targeted.groupBy(*TARGET_KEY).agg(
        F.sum("percentage").alias("total"), F.count("*").alias("payees")
    )
    steps = targeted.select(
        *TARGET_KEY,
        F.explode(
            F.array(
                F.struct(_from().alias("day"), F.col("percentage").alias("step")),
                F.struct(F.date_add(_to(), 1).alias("day"), (-F.col("percentage")).alias("step")),
            )
        ).alias("s"),
    ).select(*TARGET_KEY, "s.*")
    running = W.partitionBy(*TARGET_KEY).orderBy("day")
    peaks = (
        steps.groupBy(*TARGET_KEY, "day")
        .agg(F.sum("step").alias("step"))
        .withColumn("live", F.sum("step").over(running))
        .groupBy(*TARGET_KEY)
        .agg(F.max("live").alias("peak"))
    )
    return totals.join(peaks, TARGET_KEY).select(
        *TARGET_KEY,
        F.col("total").cast("decimal(38,2)").alias("total"),
        F.col("peak").cast("decimal(38,2)").alias("peak"),
        "payees",
        (F.col("total") > F.lit(MAX_PERCENT).cast(PERCENT)).alias("over"),
    )


def split_violations(rules: DataFrame) -> DataFrame:
    """Every broken split rule: (workspace_id, subject, reason).

    The subject is the rule's id, or the target's for rules that bound a target.
    """
    named = sum(((F.col(c).isNotNull()).cast("int") for c in TARGETS), F.lit(0))
    pct = F.col("percentage")
    checks = {
        "not exactly one target": named != 1,
        "percentage out of range": (pct < F.lit(MIN_PERCENT).cast(PERCENT))
        | (pct > F.lit(MAX_PERCENT).cast(PERCENT)),
        "ends before it starts": F.coalesce(
            F.col("effective_from") > F.col("effective_to"), F.lit(False)
        ),
        "blank payee": blank(F.col("payee_name")),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(why)) for why, test in checks.items()]))
    per_rule = rules.select(
        "workspace_id", F.col("id").alias("subject"), F.explode(broken).alias("reason")
    )
    per_target = split_totals(rules).select(
        "workspace_id",
        F.col("target_id").alias("subject"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("over"), F.lit("total over 100")),
                    F.when(F.col("payees") > MAX_PAYEES, F.lit("too many payees")),
                )
            )
        ).alias("reason"),
    )
    return per_rule.unionByName(per_target)


def _rule(workspace: Column) -> Column:
    return F.struct(
        workspace.alias("workspace"),
        F.col("payee_name").alias("payee_name"),
        F.col("percentage").alias("percentage"),
        _from().alias("live_from"),
        _to().alias("live_to"),
    )


def _with_level(place: int):
    """Lambda that puts the level's place in front of a rule's fields."""
    fields = ("workspace", "payee_name", "percentage", "live_from", "live_to")
    return lambda rule: F.struct(
        F.lit(place).alias("level"), *[rule[f].alias(f) for f in fields]
    )


def rules_by_track(tracks: DataFrame, rules: DataFrame, key: list[str], workspace: Column) -> DataFrame:
    """Each track's key with the rules on it, its album or its artist, as one array.

    The payee limit keeps an array to some dozens of rules per workspace that
    the track is shared with. Rules of whole workspaces are not in it.
    """
    targeted = with_target(rules)
    arrays = []
    joined = tracks.select(*key, F.col("id").alias("track_id"), "album_id", "artist_id")
    for place, level in enumerate(LEVELS[:-1]):
        name = f"{level}_rules"
        own = targeted.where(F.col("target_kind") == level)
        own = own.groupBy(F.col("target_id").alias(f"{level}_id")).agg(
            F.collect_list(_rule(workspace)).alias(name)
        )
        joined = joined.join(own, f"{level}_id", "left")
        arrays.append(F.transform(F.coalesce(F.col(name), F.array()), _with_level(place)))
    return joined.select(*key, F.concat(*arrays).alias("rules"))


def _periods(ruled: DataFrame, key: list[str]) -> DataFrame:
    """The days from OPEN_FROM to OPEN_TO cut where a rule starts or has ended, with the rules live in each part."""
    starts = F.transform("rules", lambda r: r["live_from"])
    stops = F.transform("rules", lambda r: F.date_add(r["live_to"], 1))
    ends = F.array(F.lit(OPEN_FROM).cast("date"), F.date_add(F.lit(OPEN_TO).cast("date"), 1))
    days = F.array_sort(F.array_distinct(F.concat(ends, starts, stops)))
    periods = F.transform(
        F.slice("days", 1, F.size("days") - 1),
        lambda day, i: F.struct(
            day.alias("start"), F.date_sub(F.get("days", i + 1), 1).alias("stop")
        ),
    )

    def live(period: Column) -> Column:
        return F.filter(
            "rules",
            lambda r: (r["live_from"] <= period["start"]) & (r["live_to"] >= period["start"]),
        )

    fields = ("level", "workspace", "payee_name", "percentage")
    return (
        ruled.withColumn("days", days)
        .select(*key, "rules", F.explode(periods).alias("period"))
        .select(
            *key,
            F.col("period.start").alias("period_from"),
            F.col("period.stop").alias("period_to"),
            F.transform(live(F.col("period")), lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("live"),
        )
    )


def _shown(rules: Column) -> Column:
    names = F.array(*[F.lit(name) for name in LEVELS])
    return F.transform(
        rules,
        lambda r: F.struct(
            F.element_at(names, r["level"] + 1).alias("level"),
            r["payee_name"].alias("payee_name"),
            r["percentage"].alias("percentage"),
        ),
    )


def _share(revenue: Column, percentage: Column) -> Column:
    """Part of a revenue: exact product, times 0.01, rounded half up to nine places."""
    part = revenue.cast(AMOUNT) * percentage * F.lit("0.01").cast("decimal(3,2)")
    return F.round(part, 9).cast(MONEY)


def _one_workspace(column: str) -> Column:
    """The empty name, taken from a column so that the join on it stays one by equality."""
    return F.coalesce(F.substring(column, 1, 0), F.lit(""))


def _paid_by(
    royalties: DataFrame, tracks: DataFrame, rules: DataFrame, as_of: str | None, cascade: bool
) -> DataFrame:
    """Royalties with the payees of their track on their own day, or on one given.

    Where royalties name their workspace (`workspace_id`), only its rules pay;
    where they name their owner, only the owner's tracks count. Royalties
    without these columns are all of one workspace or owner. All rule logic
    that the catalog decides is in two tables of periods without change: one
    per track and one per workspace, so a rule for everything is not copied to
    each track. A track in no catalog has no payees (null).
    """
    by_owner = OWNER in royalties.columns
    key = ["isrc", OWNER] if by_owner else ["isrc"]
    named = "workspace_id" in royalties.columns
    workspace = F.col("workspace_id") if named else _one_workspace("payee_name")
    near = _periods(rules_by_track(tracks, rules, key, workspace), key)
    near = lookup(near, row_bytes=64 + 96 * F.size("live"))
    everywhere = with_target(rules).where(F.col("target_kind") == LEVELS[-1])
    everywhere = everywhere.groupBy(workspace.alias("of_workspace")).agg(F.collect_list(_rule(workspace)).alias("all_rules"))
    everywhere = everywhere.select("of_workspace", F.transform("all_rules", _with_level(len(LEVELS) - 1)).alias("rules"))
    wide = _periods(everywhere, ["of_workspace"])
    wide = lookup(wide.withColumnRenamed("live", "everywhere"), row_bytes=64 + 96 * F.size("everywhere"))

    r, n, w = royalties.alias("r"), near.alias("n"), wide.alias("w")
    day = F.col("r.reporting_date") if as_of is None else F.lit(as_of).cast("date")
    own = F.col("r.workspace_id") if named else _one_workspace("r.isrc")
    paying = (F.col("n.period_from") <= day) & (F.col("n.period_to") >= day)
    paying &= F.trim("r.isrc") == F.col("n.isrc")  # the catalog's isrcs are trimmed, stored cells are not
    if by_owner:
        paying &= F.col(f"r.{OWNER}") == F.col(f"n.{OWNER}")
    everyone = (own == F.col("w.of_workspace")) & (F.col("w.period_from") <= day) & (F.col("w.period_to") >= day)
    joined = r.join(n, paying, "left").join(w, everyone, "left")
    mine = F.filter("live", lambda rule: rule["workspace"] == own)
    rest = F.coalesce("everywhere", F.array())
    if cascade:
        top = F.array_min(F.transform(mine, lambda rule: rule["level"]))
        nearest = F.filter(mine, lambda rule: rule["level"] == top)
        payees = F.when(F.size(mine) > 0, nearest).otherwise(rest)
    else:
        payees = F.concat(mine, rest)
    return joined.select("r.*", F.when(F.col("live").isNotNull(), _shown(payees)).alias("payees"))


def payout_fanout(royalties: DataFrame, tracks: DataFrame, rules: DataFrame,
                  as_of: str | None = None) -> DataFrame:
    """One row per royalty row and live rule on any of its levels."""
    keep = royalties.columns
    return (
        _paid_by(royalties, tracks, rules, as_of, cascade=False)
        .select(*keep, F.inline("payees"))
        .withColumn("amount", _share(F.col("net_revenue"), F.col("percentage")))
    )


def payout_cascade(royalties: DataFrame, tracks: DataFrame, rules: DataFrame,
                   as_of: str | None = None) -> DataFrame:
    """Payouts of every royalty row by its most specific live rules, with the rest.

    The rest needs the sum of the row's rounded payments. It is taken over the
    row's own payees, so no grouping of the royalties follows.
    """
    keep = royalties.columns
    revenue = F.col("net_revenue")
    # Adding two decimal(38,9) would round to eight places; this type has room.
    exact = T.DecimalType(30, 9)
    spent = F.aggregate(
        "payees",
        F.lit(0).cast(exact),
        lambda acc, p: (acc + _share(revenue, p["percentage"]).cast(AMOUNT)).cast(exact),
    )
    rest = F.struct(
        F.lit(None).cast("string").alias("level"),
        F.lit(UNALLOCATED).alias("payee_name"),
        F.lit(None).cast(PERCENT).alias("percentage"),
    )
    amount = F.when(
        F.col("percentage").isNull(), (revenue.cast(AMOUNT) - F.col("_spent")).cast(MONEY)
    ).otherwise(_share(revenue, F.col("percentage")))
    return (
        _paid_by(royalties, tracks, rules, as_of, cascade=True)
        .select(
            *keep,
            F.coalesce(spent, F.lit(0).cast(exact)).alias("_spent"),
            F.coalesce(F.concat("payees", F.array(rest)), F.array(rest)).alias("payees"),
        )
        .select(*keep, "_spent", F.inline("payees"))
        .withColumn("amount", amount)
        .drop("_spent")
    )


def payout_by_payee(royalties: DataFrame, tracks: DataFrame, rules: DataFrame,
                    as_of: str | None = None) -> DataFrame:
    """What each payee gets in all, per workspace where royalties name it, and what stays unallocated."""
    scope = [c for c in ("workspace_id", OWNER) if c in royalties.columns]
    needed = royalties.select("isrc", "reporting_date", "net_revenue", *scope)
    group = [c for c in scope if c == "workspace_id"]
    return (
        payout_cascade(needed, tracks, rules, as_of)
        .groupBy(*group, "payee_name")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("payments"))
    )


def with_catalog(royalties: DataFrame, tracks: DataFrame, albums: DataFrame,
                 artists: DataFrame) -> DataFrame:
    """Royalties with the ids and names their catalog entries carry.

    The three catalog tables are joined with each other first: the royalties
    then need one join, on the trimmed isrc, and on the owner where they name it
    (an isrc is unique within an owner only). The isrc cell stays as it is.
    """
    key = ["isrc", OWNER] if OWNER in royalties.columns else ["isrc"]
    entry = (
        tracks.select("isrc", F.col("id").alias("track_id"), "album_id", "artist_id", OWNER)
        .join(albums.select(F.col("id").alias("album_id"), F.col("title").alias("album_title")),
              "album_id", "left")
        .join(artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name")),
              "artist_id", "left")
    )
    entry = entry if OWNER in key else entry.drop(OWNER)
    entry = lookup(entry.withColumnRenamed("isrc", "_isrc"), row_bytes=256)
    same = F.trim(royalties["isrc"]) == entry["_isrc"]
    if OWNER in key:
        same &= royalties[OWNER] == entry[OWNER]
    return royalties.join(entry, same, "left").drop("_isrc", *[entry[c] for c in key if c == OWNER])


def orphans(royalties: DataFrame, tracks: DataFrame) -> DataFrame:
    """Royalty isrcs (trimmed, as the catalog has them) without a track and tracks without royalties."""
    earned = royalties.select(F.trim("isrc").alias("isrc")).distinct()
    known = tracks.select("isrc").distinct()
    return (
        earned.join(known, "isrc", "left_anti")
        .select("isrc", F.lit("no track").alias("problem"))
        .unionByName(
            known.join(earned, "isrc", "left_anti").select(
                "isrc", F.lit("no royalties").alias("problem")
            )
        )
    )
