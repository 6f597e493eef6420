"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on a ring of 2^16 cells (more where they need them) at many places each; a row's position comes
from a hash, and its shard is that of the next place clockwise. A full shard
takes no more: the rows that do not fit go on clockwise to the next place whose
shard has room. What a shard may hold is bounded, so balance is certain, and a
row leaves its own arc only where its shard is full.

Who fits is settled by counts, not row by row: rows are counted per arc, the
counts (one per place on the ring) are filled in clockwise, and an arc's rows
are then taken in ring order. With a slack of 0 the bounds add up to the number
of rows, so all shards are filled and differ by one row at most.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.ordering import ranked

BITS = 16  # of a cell's number, at least
PLACES = 64  # virtual nodes of a shard


def ring_bits(nodes: int) -> int:
    """Bits of a cell's number on a ring with so many places: at least half of the cells stay free."""
    return max(BITS, (2 * nodes - 1).bit_length())


def ring(shards: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; one node to a cell.

    A node whose cell is taken by a lower-numbered shard moves on to its next
    hash, so one more shard leaves the others where they are. Twice the cells
    cut each in two, and the order of the places stays.
    """
    taken: dict[int, int] = {}
    bits = ring_bits(shards * places)
    for shard in range(shards):
        for place in range(places):
            turn = 0
            while (cell := _cell(shard, place, turn, bits)) in taken:
                turn += 1
            taken[cell] = shard
    return sorted(taken.items())


def _cell(shard: int, place: int, turn: int, bits: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{shard}/{place}/{turn}".encode()).digest()[:8], "big") >> (64 - bits)


@dataclass(frozen=True)
class Piece:
    """Rows `first` to `first + count` of an arc, which go to a shard from its slot `slot` on."""

    arc: int
    first: int
    count: int
    shard: int
    slot: int


def fill(counts: list[int], owners: list[int], bounds: list[int]) -> list[Piece]:
    """Where each arc's rows go: first all to their own shard, what is over one place on, and so on."""
    room, slots = list(bounds), [0] * len(bounds)
    waiting = [(arc, 0, n, arc) for arc, n in enumerate(counts) if n]
    pieces = []
    while waiting:
        over = []
        for arc, first, n, at in waiting:
            shard = owners[at]
            fits = min(n, room[shard])
            if fits:
                pieces.append(Piece(arc, first, fits, shard, slots[shard]))
                room[shard] -= fits
                slots[shard] += fits
            if n > fits:
                over.append((arc, first + fits, n - fits, (at + 1) % len(owners)))
        waiting = over
    return pieces


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: an even share, and `slack` times that on top."""
    extra = int(rows / shards * slack)
    return [rows // shards + (k < rows % shards) + extra for k in range(shards)]


def position(*columns: Column) -> Column:
    """An unsigned 63-bit place on the ring."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A frame of longs from a few rows that the driver has."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))


def assign(frame: DataFrame, key: list[str], shards: int = 8, places: int = PLACES, slack: float = 0.0) -> DataFrame:
    """The frame with `shard` and `slot`, gapless from 0 in each shard.

    The place on the ring comes from the key columns, nulls included; rows with
    one key are dealt by the order of the key and may part where a shard is
    full. Existing columns of these names are replaced. An empty frame stays so.
    """
    nodes = ring(shards, places)
    owners = [shard for _, shard in nodes]
    own = frame.drop("shard", "slot").withColumn("__position", position(*[F.col(k) for k in key]))
    rows = ranked(own, ["__position", *key], "__rank")
    bits = ring_bits(len(nodes))
    cell = F.shiftright("__position", 63 - bits)
    # The ring is a table of the arc of each cell: four cells at most for each place. Cells beyond the last place belong to the first.
    ends = [cell for cell, _ in nodes]
    spans = [(arc, start + 1, end) for arc, (start, end) in enumerate(zip([-1, *ends[:-1]], ends, strict=True)) if end > start]
    last = (1 << bits) - 1
    spans += [(0, ends[-1] + 1, last)] if ends[-1] < last else []
    spark = frame.sparkSession
    arcs = small_table(spark, spans, ["__arc", "low", "high"])
    where = arcs.select("__arc", F.explode(F.sequence("low", "high")).alias("__cell"))
    rows = rows.withColumn("__cell", cell).join(F.broadcast(where), "__cell")
    found = {r[0]: r for r in rows.groupBy("__arc").agg(F.count(F.lit(1)), F.min("__rank"), F.sum((F.col("__cell") <= nodes[-1][0]).cast("long"))).collect()}
    counts = [found[a][1] if a in found else 0 for a in range(len(nodes))]
    total = sum(counts)
    # The first arc goes over the ring's end: its rows there come before those at the start.
    tail = counts[0] - (found[0][3] if 0 in found else 0)
    taken = []
    for p in fill(counts, owners, bounds(total, shards, slack)):
        if p.arc:
            parts = [(found[p.arc][2], 0, p.count)]
        else:
            before = min(max(tail - p.first, 0), p.count)
            parts = [(total - tail, 0, before), (-tail, before, p.count)]
        # Ranks from..to of the arc become slots of the shard.
        taken += [(p.arc, base + p.first + x, base + p.first + y, p.shard, p.slot - p.first - base) for base, x, y in parts if y > x]
    pieces = small_table(spark, taken, ["__arc", "__from", "__to", "shard", "__slot"])
    within = (F.col("r.__arc") == F.col("t.__arc")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    joined = rows.alias("r").join(F.broadcast(pieces.alias("t")), within)
    return joined.select(*[F.col(f"r.`{c}`") for c in own.columns if c != "__position"], F.col("shard").cast("int").alias("shard"), (F.col("__rank") + F.col("__slot")).alias("slot"))


def key_columns(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    text = F.col(text_column)
    return [
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ]


def shard_documents(documents: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shards differ by one row at most. A null text has size 1
    and no checksum; a null doc_id is a key like any other. Texts of any length
    are measured whole; other columns have no part, whatever their names. Rows that agree in
    all of doc_id, size and checksum are dealt as they come, each to one slot.
    """
    keys = documents.select(*key_columns(id_column, text_column))
    placed = assign(keys, ["doc_id", "size", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
