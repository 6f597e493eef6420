"""Near-duplicate documents by circulant MinHash, each link confirmed on full shingle sets.

Two fixed permutations of the universe of 2^32 positions make a whole signature:
the first, `sigma`, scatters a set's shingles, and the second, `pi`, is applied
to the same positions shifted round the circle by 0, 1, 2, ... steps, one shift
per coordinate. Bands of coordinates bring candidates together; only pairs whose
exact Jaccard similarity reaches the threshold become links.

With 48 bands of 4 coordinates a pair of similarity 0.75 shares no band with
probability (1 - 0.75^4)^48, about 1e-8; more similar pairs still less.

Documents with equal sets are one candidate, whatever their number. Each set is
first checked against the smallest set of the buckets it shares most often; what
is linked by then is one component. Buckets that hold one component are done.
The sets of all others meet once more, across components only, through their
rarest shingles: of two sets that are similar enough both have a shared one
among these, at places that leave room for the rest (prefix and position
filters, which are exact). So a large group of near copies costs a few checks
per member, not one per pair, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.graph import components
from cadenza.llm.tokens import lists, mixed, signed, spaced, words
from cadenza.session import staged

SHINGLE = 5
BANDS = 48
ROWS = 4
THRESHOLD = 75  # percent
FIRST = 3  # buckets' smallest sets that each set is checked against first

_ORDER = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_ROW = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = 256  # shingles taken at once: the block stays in the processor's cache


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes.

    Five words in a row; of fewer words the whole sequence is one shingle; a row
    without words has none.
    """
    for part in words(column, spaced):
        w, counts = part.hashes, part.counts
        n = len(w)
        rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            rolled += w[k : k + len(rolled)] * _ORDER[k]
        rolled = mixed(rolled)
        at = 0
        for count in counts.tolist():
            if count >= SHINGLE:
                yield np.unique(rolled[at : at + count - SHINGLE + 1])
            elif count:
                yield mixed((w[at : at + count] * _ORDER[:count]).sum(keepdims=True) + _SHORT * np.array([count], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += count


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of pi over the positions sigma gives, shifted once per coordinate."""
    sigma = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), _COLUMNS):
        pi = sigma[at : at + _COLUMNS] + _SHIFTS
        pi *= np.uint32(0x7FEB352D)
        pi ^= pi >> np.uint32(15)
        pi *= np.uint32(0x846CA68B)
        np.minimum(least, pi.min(axis=1), out=least)
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    coordinates = signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((coordinates * _ROW).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _SHORT)


def _set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        return int(signed(mixed(shingles).sum(keepdims=True))[0]), int(signed(mixed(shingles * _SHORT).sum(keepdims=True))[0])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, first, second, bands = [], [], [], []
        for own in shingle_sets(batch.column(1)):
            n.append(len(own))
            keys = _set_keys(own) if len(own) else (0, 0)
            first.append(keys[0])
            second.append(keys[1])
            bands.append(band_keys(own) if len(own) else own)
        values = signed(np.concatenate(bands)) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists([len(b) for b in bands], values, pa.int64())],
            ["node", "n", "key", "key2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = list(shingle_sets(batch.column(1)))
        values = signed(np.concatenate(own)) if own else np.zeros(0, np.int64)
        sizes = [len(s) for s in own]
        keys = [_set_keys(s)[0] if len(s) else 0 for s in own]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists(sizes, values, pa.int64())], ["node", "set", "n", "shingles"])


def _similar(common: Column, one: Column, other: Column) -> Column:
    return 100 * common >= THRESHOLD * (one + other - common)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs `a`, `b` those whose whole sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(other, "b").where(_similar(common, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _across(sets: DataFrame) -> DataFrame:
    """Pairs `a`, `b` of sets in different components that can be similar enough.

    Shingles are ordered by how many of the sets have them. With sizes m and n a
    similarity of t takes an overlap of t (m + n) / (1 + t), so the first shared
    shingle has at least that many places from its own to the end in either set.
    """
    each = sets.select("node", "component", "n", "set", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rank = F.dense_rank().over(Window.partitionBy("node", "set").orderBy(F.col("often").asc_nulls_first(), "shingle"))
    front = each.join(often, "shingle", "left").withColumn("place", rank)
    front = front.where((100 * (F.col("n") - F.col("place") + 1) >= THRESHOLD * F.col("n")) & F.col("often").isNotNull())
    front = staged(front.select("shingle", "node", "component", "n", "place"))
    l, r = front.alias("l"), front.alias("r")
    n, m = F.col("l.n"), F.col("r.n")

    def room(size: Column, place: Column) -> Column:
        return (100 + THRESHOLD) * (size - place + 1) >= THRESHOLD * (n + m)

    fits = (
        (F.col("l.shingle") == F.col("r.shingle"))
        & (F.col("l.component") < F.col("r.component"))
        & (100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m))
        & room(n, F.col("l.place"))
        & room(m, F.col("r.place"))
    )
    return l.join(r, fits).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after some more links, which are few: only their ends' components meet again."""
    of_a = label.select(F.col("node").alias("a"), F.col("component").alias("at_a"))
    of_b = label.select(F.col("node").alias("b"), F.col("component").alias("at_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    merged = staged(components(ends.select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b"))))
    moved = label.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    own = moved.select("node", F.coalesce("to", "component").alias("component"))
    return own.union(merged.join(label, "node", "left_anti"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, kept says whether
    it is the row's own. A null or empty text, or one without words, has no
    shingles and no link. A row with a null doc_id is linked with nothing: its
    component_id is null and it is kept. Rows that repeat a doc_id are one
    document with several texts: it has the links of all of them. Extra columns
    are not looked at. An empty table gives an empty result.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).alias("text"))
    sketches = staged(texts.mapInArrow(_sketch, "node long, n long, key long, key2 long, bands array<long>"))
    linkable = sketches.where("node is not null and n > 0")
    key = ["key", "key2", "n"]
    first = linkable.groupBy(*key).agg(F.min("node").alias("rep"))
    # A set's first document stands for all documents with that set.
    banded = linkable.join(first, key).where("node = rep").select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last")
    met = staged(banded.join(shared.select("bucket", "pivot"), "bucket").distinct())
    wanted = met.select(F.col("rep").alias("node")).distinct()
    once = texts.join(wanted, "node", "left_semi").dropDuplicates(["node", "text"])
    sets = staged(once.mapInArrow(_sets, "node long, set long, n long, shingles array<long>"))

    shares = met.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    order = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("bands"), "pivot"))
    tried = shares.withColumn("order", order).where(F.col("order") <= FIRST).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    # Documents with more than one text tie their sets together.
    several = linkable.join(first, key).select("node", "rep").distinct()
    tied = several.join(several.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("node", "a"), "node")
    links = staged(_confirmed(tried, sets).union(tied.select("a", F.col("rep").alias("b"))))
    label = components(links)

    here = met.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = here.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    apart = staged(here.join(open_, "bucket", "left_semi").select(F.col("rep").alias("node"), "component").distinct())
    more = staged(_confirmed(_across(sets.join(apart, "node")), sets))
    if more.limit(1).count():
        label = _joined(label, more)

    group = first.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    rows = sketches.select("node", *key).join(group, key, "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component", "node"))
    return rows.select(
        F.col("node").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("node"), F.lit(True)).alias("kept"),
    )
