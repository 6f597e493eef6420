"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions alone.

A source's target over its size is the copies each of its documents should have
on average; the whole part is given, the fraction is a probability. Pivotal
rounding settles these: two documents meet, words move from one to the other so
that their sum stays the same, until one of them has a whole copy or none. Which
way words move is drawn so that no document's expected copies change. So a
source's words stay what they were, up to the last document left.

It runs as a reduction tree. Documents of a source and size class (powers of two)
in a random but fixed order fill groups of `FAN`; each group settles all but one
of its documents, and those left over meet in the groups of the next level. At
the root a source has one document per size class left, some twenty at most;
these are settled from the largest down, each taken if it still fits the words
that their shares add up to, so the error is of the smallest ones' size. A level is one shuffle of what
the level before left, a group never holds more than FAN rows, and 5 levels are
enough for 10^12 documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.ordering import ranked
from cadenza.session import staged

FAN = 256
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"

_UNIT = ["source_key", "doc_id", "size", "text_hash"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source_size, target of each source in a table of sizes.

    Sources in code-point order, null last, take the weights in turn and share
    `share` times all words by them. Where that is over `most` times a source's
    size, it stops there and the others share what is over, again by weight,
    until none is above.
    """
    sums = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("last", F.col("source_key") == "")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = ranked(sums, ["last", "source_key"])
    placed = staged(placed.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))))
    full = F.lit(float(most)) * F.col("source_size")
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > full
        now = placed.agg(
            F.sum(F.when(over, full).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.sum(over.cast("long")).alias("n"),
            F.sum("source_size").alias("words"),
        ).first()
        if not now["weight"] or now["n"] == stopped:
            break
        stopped, level = now["n"], (share * now["words"] - now["stopped"]) / now["weight"]
    return placed.select("source_key", "source_size", F.least(full, F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _meet(held: Column, come: Column) -> Column:
    """The one document held back and the next one: one is settled, the other is held back."""

    def settle(at: Column, up: int, left: Column, share: Column) -> Column:
        done = F.array(F.struct(at["id"].alias("id"), F.lit(up).alias("up")))
        return F.struct(left["id"].alias("id"), share.alias("share"), left["words"].alias("words"), F.concat(held["settled"], done).alias("settled"))

    ratio = come["words"] / held["words"]
    gain = F.least(1 - held["share"], come["share"] * ratio)
    loss = F.least(held["share"], (1 - come["share"]) * ratio)
    gains = _uniform(held["id"], come["id"]) * (gain + loss) < loss
    met = (
        F.when(gains & (1 - held["share"] <= come["share"] * ratio), settle(held, 1, come, F.greatest(F.lit(0.0), come["share"] - gain / ratio)))
        .when(gains, settle(come, 0, held, F.least(F.lit(1.0), held["share"] + gain)))
        .when(held["share"] <= (1 - come["share"]) * ratio, settle(held, 0, come, F.least(F.lit(1.0), come["share"] + loss / ratio)))
        .otherwise(settle(come, 1, held, F.greatest(F.lit(0.0), held["share"] - loss)))
    )
    first = F.struct(come["id"].alias("id"), come["share"].alias("share"), come["words"].alias("words"), held["settled"].alias("settled"))
    return F.when(held["id"].isNull(), first).otherwise(met)


def _level(units: DataFrame) -> DataFrame:
    """One level of the tree: per group the settled documents and the one left."""
    none = "struct(cast(null as bigint) id, cast(null as double) share, cast(null as double) words, cast(array() as array<struct<id:bigint,up:int>>) settled)"
    group = F.sort_array(F.collect_list(F.struct("id", "share", "words")))
    met = units.groupBy("source_key", "class", "block").agg(group.alias("group"))
    return met.select("source_key", "class", "block", F.aggregate("group", F.expr(none), _meet).alias("met"))


def _fit(acc: Column, unit: Column) -> Column:
    """The root: take a document if that brings the words still open nearer to none."""
    up = unit["words"] <= acc["open"] + F.when(unit["last"], unit["words"] / 2).otherwise(0.0)
    done = F.array(F.struct(unit["id"].alias("id"), up.cast("int").alias("up")))
    return F.struct((acc["open"] - F.when(up, unit["words"]).otherwise(0.0)).alias("open"), F.concat(acc["settled"], done).alias("settled"))


def _root(left: DataFrame) -> DataFrame:
    """id, up of what is left of each source: a document per size class, at most 64."""
    group = F.reverse(F.sort_array(F.collect_list(F.struct("words", "id", "share"))))
    of = left.groupBy("source_key").agg(group.alias("group"))
    last = F.element_at("group", -1)["id"]
    open_ = F.aggregate("group", F.lit(0.0), lambda acc, u: acc + u["words"] * u["share"])
    units = F.transform("group", lambda u: F.struct(u["id"].alias("id"), u["words"].alias("words"), (u["id"] == last).alias("last")))
    start = F.struct(open_.alias("open"), F.expr("cast(array() as array<struct<id:bigint,up:int>>)").alias("settled"))
    return of.select(F.inline(F.aggregate(units, start, _fit)["settled"]))


def rounded(units: DataFrame) -> DataFrame:
    """id, up: whether each unit gets one copy more.

    Units have id (0, 1, 2, ... without great gaps, in the order of meeting),
    source_key, share (0 to 1) and words over 0.
    """
    size_class = F.floor(F.log2("words"))
    left = staged(units.select("source_key", size_class.alias("class"), F.floor(F.col("id") / FAN).alias("block"), "id", "share", "words"))
    blocks = left.agg(F.max("block").alias("most")).first()["most"]
    settled = []
    while blocks is not None:
        made = staged(_level(left))
        settled.append(made.select(F.inline("met.settled")))
        left = made.select("source_key", "class", F.floor(F.col("block") / FAN).alias("block"), "met.id", "met.share", "met.words")
        if blocks == 0:
            break
        blocks //= FAN
    return reduce(DataFrame.union, settled, _root(left))


def mixed_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Copies per document, for `with_copies` to join to rows of `documents`.

    The frame has source_key, doc_id, size, text_hash, source_size, target and
    copies, once per different key.
    """
    return copies_of(sized(documents, id_column, text_column, source_column))


def copies_of(rows: DataFrame) -> DataFrame:
    """`mixed_copies` of rows that have the key columns."""
    units = staged(rows.groupBy(*_UNIT).agg(F.count(F.lit(1)).alias("n")))
    targets = staged(source_targets(units.select("source_key", (F.col("size") * F.col("n")).alias("size"))))
    order = ranked(units.withColumn("class", F.floor(F.log2(F.col("size") * F.col("n")))).withColumn("turn", F.xxhash64(F.lit(SEED), *_UNIT)), ["source_key", "class", "turn", "doc_id", "size", "text_hash"], "id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = staged(order.join(targets, "source_key").withColumn("rate", rate).withColumn("whole", F.floor("rate")))
    share = (F.col("rate") - F.col("whole")).alias("share")
    open_ = known.select("id", "source_key", share, (F.col("size") * F.col("n")).cast("double").alias("words")).where("share > 0 and words > 0")
    copies = known.join(rounded(open_), "id", "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0)))
    return copies.select(*_UNIT, "source_size", "target", "copies")


def sized(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The key columns of each row: source_key, doc_id, size and text_hash."""
    return documents.select(*key_columns(id_column, text_column, source_column))


def key_columns(id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> list[Column]:
    return [
        # A null source is the empty key, others start with a mark.
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("source_key"),
        F.col(id_column).alias("doc_id"),
        F.coalesce(word_count(F.col(text_column)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("text_hash"),
    ]


def word_count(text: Column) -> Column:
    """Words of a text, without a list of them: each becomes one letter, then letters are counted."""
    marks = F.regexp_replace(text, WORD, "w")
    return F.length(marks) - F.length(F.replace(marks, F.lit("w"), F.lit("")))


def with_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows that have the key columns, with what `mixed_copies` found for them."""
    r, c = rows.alias("r"), copies.alias("c")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in _UNIT]
    return r.join(c, reduce(Column.__and__, same)).select("r.*", "c.source_size", "c.target", "c.copies")


def mix(documents: DataFrame, **columns: str) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies.

    A null or empty text has size 0 and takes no part in the rounding; a null
    source is a source of its own, a null doc_id an id like any other. Rows that
    agree in source, doc_id and text are one document and get equal copies. No
    row has more than two. An empty table gives an empty result.
    """
    rows = staged(sized(documents, **columns))
    found = with_copies(rows, copies_of(rows))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))
