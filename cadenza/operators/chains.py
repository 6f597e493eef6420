"""Greedy runs: each key's rows cut into consecutive runs, first row first.

A run ends before the row that comes `span` or more after the run's first row,
that would be row `size + 1`, or that comes more than `gap` after the row before
it. Where one run starts depends on where the last one did, so SQL windows
cannot express it; a small loop over sorted Arrow batches can.

Ordinary keys are hashed to tasks. A busy key is cut into slices that run at
once: a first pass tells, for every row a run could start with when it comes in
from the slice before, which run is open at the slice's end. Chaining those
answers per key (one small row per slice) gives every slice its true start, and
a second pass numbers the rows. Results are the same as in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.ordered import SLICE, SLICE_ROWS, part, slices

NEVER = np.iinfo(np.int64).max
NO_KEY = "\x00"
OPEN = {"_in_ts": "bigint", "_in_id": "bigint", "_in_count": "bigint", "_in_last": "bigint"}


@dataclass(frozen=True)
class Rule:
    """When a run ends, in microseconds and rows."""

    span: int
    size: int = NEVER
    gap: int = NEVER

    def ends(self, ts: int, start: int, count: int, last: int) -> bool:
        return ts - start >= self.span or count >= self.size or ts - last > self.gap


def _label(rule: Rule, incoming: bool):
    """Batches with each row's run: its first row's time and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = object()
        start = first = count = last = 0
        fresh = True
        for batch in batches:
            starts, firsts = [], []
            if incoming and fresh and len(batch) and not pd.isna(batch["_in_ts"].iat[0]):
                key = batch["_key"].iat[0]
                start, first, count, last = (int(batch[c].iat[0]) for c in OPEN)
            fresh = fresh and not len(batch)
            rows = zip(batch["_key"].tolist(), batch["_ts"].tolist(), batch["_id"].tolist())
            for own, ts, row in rows:
                if own != key or rule.ends(ts, start, count, last):
                    key, start, first, count = own, ts, row, 0
                count += 1
                last = ts
                starts.append(start)
                firsts.append(first)
            batch = batch.drop(columns=list(OPEN)) if incoming else batch
            yield batch.assign(run_ts=np.array(starts, "int64"), run_id=np.array(firsts, "int64"))

    return run


def _next_start(ts: np.ndarray, rule: Rule) -> np.ndarray:
    """For each row, the row that would start the run after one started there."""
    n = len(ts)
    place = np.arange(n)
    by_span = np.searchsorted(ts, ts + rule.span, side="left")
    by_size = place + min(rule.size, n)
    breaks = np.flatnonzero(np.diff(ts) > rule.gap) + 1
    later = np.searchsorted(breaks, place, side="right")
    by_gap = np.append(breaks, n)[later]
    return np.minimum(np.minimum(by_span, by_size), by_gap)


def _open_at_end(ts: np.ndarray, rule: Rule) -> np.ndarray:
    """For each row, the start of the run open at the end if a run starts there.

    By pointer doubling: every row points to the start of the run after its
    own, the last start to itself, and pointers jump twice as far each turn.
    """
    follow = _next_start(ts, rule)
    place = np.arange(len(ts))
    jump = np.where(follow < len(ts), follow, place)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


SUMMARY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("opens", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_ts", T.LongType()),
        T.StructField("last_ts", T.LongType()),
        T.StructField("first_gap", T.LongType()),
        T.StructField("entry_row", T.ArrayType(T.LongType())),
        T.StructField("entry_ts", T.ArrayType(T.LongType())),
        T.StructField("open_ts", T.ArrayType(T.LongType())),
        T.StructField("open_id", T.ArrayType(T.LongType())),
        T.StructField("open_count", T.ArrayType(T.LongType())),
    ]
)


def _summarise(rule: Rule):
    """One row for a slice's first key and one for its last.

    Entries leading to the same open run are stored as one, by the last of
    them. Only rows that a run from the slice before can reach are entries.
    """

    def describe(key, number, ts, ids, opens) -> dict:
        n = len(ts)
        opened = _open_at_end(ts, rule)
        entries = 1 if opens else int(np.searchsorted(ts, ts[0] + rule.span, side="left")) + 1
        opened_in = opened[: min(entries, n)]
        ends = np.flatnonzero(np.append(np.diff(opened_in) != 0, True))
        chosen = opened_in[ends]
        gaps = np.flatnonzero(np.diff(ts) > rule.gap)
        return {
            "key": key,
            "number": number,
            "opens": opens,
            "rows": n,
            "first_ts": int(ts[0]),
            "last_ts": int(ts[-1]),
            "first_gap": int(gaps[0]) + 1 if len(gaps) else n,
            "entry_row": ends.tolist(),
            "entry_ts": ts[ends].tolist(),
            "open_ts": ts[chosen].tolist(),
            "open_id": ids[chosen].tolist(),
            "open_count": (n - chosen).tolist(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b[["_key", "_ts", "_id", SLICE]] for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys = rows["_key"]
        number = int(rows[SLICE].iat[0])
        ts, ids = rows["_ts"].to_numpy(), rows["_id"].to_numpy()
        head = int((keys == keys.iat[0]).sum())
        out = [describe(keys.iat[0], number, ts[:head], ids[:head], opens=False)]
        if head < len(rows):
            tail = len(rows) - int((keys == keys.iat[-1]).sum())
            out.append(describe(keys.iat[-1], number, ts[tail:], ids[tail:], opens=True))
        yield pd.DataFrame(out)

    return run


INCOMING = f"{SLICE} int, " + ", ".join(f"{c} {t}" for c, t in OPEN.items())


def _chain(rule: Rule):
    """The run open at each slice's start, slice by slice of one key."""

    def run(summaries: pd.DataFrame) -> pd.DataFrame:
        out = []
        state = None
        for s in summaries.sort_values("number").itertuples(index=False):
            entry = 0
            if state is not None:
                start, first, count, last = state
                out.append((s.number, start, first, count, last))
                by_span = np.searchsorted(s.entry_ts, start + rule.span, side="left")
                by_size = np.searchsorted(s.entry_row, max(rule.size - count, 0), side="left")
                gap_row = 0 if s.first_ts - last > rule.gap else s.first_gap
                by_gap = np.searchsorted(s.entry_row, gap_row, side="left")
                entry = min(by_span, by_size, by_gap)
            if entry < len(s.entry_row):
                state = (s.open_ts[entry], s.open_id[entry], s.open_count[entry], s.last_ts)
            else:
                state = (start, first, count + s.rows, s.last_ts)
        return pd.DataFrame(out, columns=[SLICE, *OPEN])

    return run


def runs(
    rows: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    rule: Rule,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rows with `run_ts` (microseconds) and `run_id`: their run's first row.

    `row_id` is a whole number that tells rows of equal time apart.
    """
    columns = rows.columns
    prepared = rows.select(
        *columns,
        F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts"),
        F.col(row_id).cast("bigint").alias("_id"),
    )
    order = ["_ts", "_id"]
    labelled = T.StructType(
        [*prepared.schema.fields, T.StructField("run_ts", T.LongType()), T.StructField("run_id", T.LongType())]
    )
    plain, busy, cuts = part(prepared, ["_key"], slice_rows)
    result = (
        plain.repartition("_key")
        .sortWithinPartitions("_key", *order)
        .mapInPandas(_label(rule, incoming=False), labelled)
    )
    if busy is not None:
        cut = slices(busy, ["_key"], order, cuts)
        summaries = cut.select("_key", "_ts", "_id", SLICE).mapInPandas(_summarise(rule), SUMMARY)
        incoming = summaries.groupBy("key").applyInPandas(_chain(rule), INCOMING)
        # At most one row per slice.
        entered = cut.join(F.broadcast(incoming), SLICE, "left").select(
            *prepared.columns, *OPEN
        )
        result = result.unionByName(
            entered.mapInPandas(_label(rule, incoming=True), labelled)
        )
    return result.select(*columns, "run_ts", "run_id")
