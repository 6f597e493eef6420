"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected on a few random directions, shifted, and put in order along
a Hilbert curve; that is done `CURVES` times with other directions and shifts.
Spark range-partitions each order. A query stands in every order at its own
place, and its candidates are the entries of a window before and after it on each
curve; the windows' finds are merged and ranked by the exact inner product.

The window follows the table: the true neighbours of `SAMPLE` queries are found
by brute force, and of all numbers of curves with the window, `WINDOW` at least,
that holds `TARGET` of them, the pair is taken that looks at the fewest entries.
Data without structure end up with one curve and a window as long as the curve.

A largest inner product is a nearest point once every vector gets one more
component that lengthens it to the longest one's length, and queries are brought
to that length without it. Equal vectors are one entry, whatever their number:
of each the few smallest ids that an answer can hold are kept, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.ordering import ranked
from cadenza.session import staged

CURVES = 10
#: Smallest window, in entries each way.
WINDOW = 4096
#: The window must hold this share of the true neighbours of so many queries, chosen by hash.
TARGET = 0.96
SAMPLE = 200
#: Bytes of the vectors of a block, and queries that meet a block in one task: bounds on a task's memory.
BLOCK_BYTES = 1 << 24
ASKS = 8192
AXES = 8
BITS = 7
REACH = 2.5  # standard deviations on either side that the curve's cube covers
SEED = 17


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2^bits."""
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns and reflections, from the coarsest cell
        high, rest = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(axes):
            flip = (x[i] & high) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(flip, rest, swap)
            x[i] ^= swap
    for i in range(1, axes):  # Gray code across the axes
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def _directions(dimension: int, axes: int) -> np.ndarray:
    """Of each curve, orthogonal directions in one dimension more than the vectors'."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return np.stack([np.linalg.qr(rng.normal(size=(dimension + 1, max(axes, 1))))[0] for _ in range(CURVES)])


def _shifts(axes: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED + 1)).random((CURVES, axes))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _lengthened(vectors: np.ndarray, queries: np.ndarray, longest: float) -> np.ndarray:
    """In the unit ball with one more component; rows marked as queries have 0 there."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    scale = np.where(queries, norms, longest)
    more = np.where(queries, 0.0, np.sqrt(np.maximum(0.0, 1 - (norms / longest) ** 2)))
    return np.column_stack((vectors / scale[:, None], more))


def _spread(dimension: int, axes: int, longest: float):
    """Sums and squares of the projections, from which the cubes are laid."""
    directions = _directions(dimension, axes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = np.zeros((CURVES, axes)), np.zeros((CURVES, axes)), 0
        for batch in batches:
            vectors = _matrix(batch.column(0), dimension)
            for c, point in enumerate(_project(vectors, np.zeros(len(vectors), bool), longest, directions)):
                total[c] += point.sum(axis=0)
                square[c] += (point * point).sum(axis=0)
            n += len(vectors)
        axis = np.arange(CURVES * axes)
        yield pa.RecordBatch.from_arrays([pa.array(axis), pa.array(total.ravel()), pa.array(square.ravel()), pa.array(np.full(len(axis), n))], ["axis", "total", "square", "n"])

    return sums


def _project(vectors: np.ndarray, queries: np.ndarray, longest: float, directions: np.ndarray) -> Iterator[np.ndarray]:
    points = _lengthened(vectors, queries, longest)
    for own in directions:
        yield points @ own


def _placer(dimension: int, axes: int, longest: float, mean: np.ndarray, deviation: np.ndarray):
    directions, shifts = _directions(dimension, axes), _shifts(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            vectors = _matrix(batch.column(3), dimension)
            for c, point in enumerate(_project(vectors, queries, longest, directions)):
                cube = np.clip((point - mean[c]) / deviation[c] / (2 * REACH) + 0.5, 0, 1)
                cells = np.minimum((cube + shifts[c]) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)
                key = hilbert_keys(cells, BITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), c), pa.int32()), pa.array(key), *batch.columns],
                    ["curve", "place", "key", "key2", "is_query", "vector"],
                )

    return place


def _truth(asked: np.ndarray, dimension: int, k: int):
    """The k best entries of a partition for each of a few queries."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, keys = np.zeros((len(asked), 0)), np.zeros((len(asked), 0, 2), np.int64)
        for batch in batches:
            own = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)])
            score = np.hstack((score, asked @ _matrix(batch.column(2), dimension).T))
            keys = np.concatenate((keys, np.broadcast_to(own, (len(asked), *own.shape))), axis=1)
            some = np.argsort(-score, axis=1)[:, :k]
            score, keys = np.take_along_axis(score, some, axis=1), np.take_along_axis(keys, some[:, :, None], axis=1)
        number = np.repeat(np.arange(len(asked)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(keys[:, :, 0].ravel()), pa.array(keys[:, :, 1].ravel()), pa.array(score.ravel())], ["ask", "key", "key2", "score"])

    return best


def _window(ordered: DataFrame, points: DataFrame, asks: DataFrame, dimension: int, k: int, entries: int) -> tuple[int, int]:
    """Entries each way, and how many curves, that hold TARGET of the true neighbours of a sample of queries at the least cost."""
    chosen = asks.orderBy("key", "key2").limit(SAMPLE)
    asked = points.join(F.broadcast(chosen), ["key", "key2"]).collect()  # SAMPLE rows
    if not asked:
        return WINDOW, 1
    finder = _truth(np.array([r["vector"] for r in asked], float), dimension, k + 1)
    found = points.select("key", "key2", "vector").mapInArrow(finder, "ask long, key long, key2 long, score double")
    order = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "key", "key2"))
    true = found.withColumn("o", order).where(F.col("o") <= k + 1).collect()  # SAMPLE x (k + 1) rows
    own = [(r["key"], r["key2"]) for r in asked]
    pairs = [(own[r["ask"]], (r["key"], r["key2"])) for r in true if own[r["ask"]] != (r["key"], r["key2"])]
    names = ordered.sparkSession.createDataFrame(sorted({x for pair in pairs for x in pair}) or own, "key long, key2 long")
    places: dict[tuple, dict[int, int]] = {}
    for r in ordered.join(F.broadcast(names), ["key", "key2"]).select("key", "key2", "is_query", "curve", "rank").collect():
        places.setdefault((r["key"], r["key2"], r["is_query"]), {})[r["curve"]] = r["rank"]
    if not pairs:
        return WINDOW, 1
    apart = np.array([[abs(places[(*q, True)][c] - places[(*d, False)][c]) for c in range(CURVES)] for q, d in pairs])
    nearest_so_far = np.minimum.accumulate(apart, axis=1)  # on the first curve, the first two, and so on
    windows = [max(WINDOW, int(w)) for w in np.quantile(nearest_so_far, TARGET, axis=0, method="higher")]
    costs = [min(2 * w + 1, entries) * (c + 1) for c, w in enumerate(windows)]
    used = int(np.argmin(costs))
    return windows[used], used + 1


def _searcher(dimension: int, k: int, window: int):
    def search(table: pa.Table) -> pa.Table:
        asks = table.column("is_query").to_numpy()
        rank = table.column("rank").to_numpy()
        vectors = _matrix(table.column("vector").combine_chunks(), dimension)
        keys = np.column_stack((table.column("key").to_numpy(), table.column("key2").to_numpy()))
        data, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 21) // max(1, len(data)))
        for at in range(0, len(ask), step) if len(data) else ():
            own = ask[at : at + step]
            score = vectors[own] @ vectors[data].T
            score[np.abs(rank[own][:, None] - rank[data]) > window] = -np.inf
            least = np.partition(score, -min(k + 1, len(data)), axis=1)[:, -min(k + 1, len(data))]
            # A little under the last place, as the product of matrices rounds its sums in another order.
            near = (score >= (least - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 0))))[:, None]) & np.isfinite(score)
            q, d = np.nonzero(near)
            found.append((own[q], data[d], (vectors[own[q]] * vectors[data[d]]).sum(axis=1)))
        q, d, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([keys[q, 0], keys[q, 1], keys[d, 0], keys[d, 1], score], ["q", "q2", "key", "key2", "score"])

    return search


def _curves(entries: DataFrame, points: DataFrame, dimension: int) -> DataFrame:
    """Entries on each curve, with their rank on it."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = points.agg(F.max(norm).alias("m")).first()["m"] or 1.0
    axes = min(AXES, dimension)
    moments = points.select("vector").mapInArrow(_spread(dimension, axes, longest), "axis long, total double, square double, n long")
    laid = moments.groupBy("axis").agg(F.sum("total"), F.sum("square"), F.sum("n")).orderBy("axis").collect()  # CURVES x AXES rows
    total, square, n = (np.array([r[i] for r in laid] or [0.0] * CURVES * axes, float).reshape(CURVES, axes) for i in (1, 2, 3))
    mean = total / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum(square / np.maximum(n, 1) - mean**2, 1e-12))

    curves = entries.mapInArrow(_placer(dimension, axes, longest, mean, deviation), "curve int, place long, key long, key2 long, is_query boolean, vector array<double>")
    ordered = ranked(curves, ["curve", "place", "key", "key2", "is_query"])
    starts = ordered.groupBy("curve").agg(F.min("rank").alias("start"))
    return ordered.join(F.broadcast(starts), "curve").withColumn("rank", F.col("rank") - F.col("start"))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `every` divides.

    Null, zero, and not wholly finite vectors, those of another length than most,
    and rows without an id take no part. Rows that repeat an id and vector are
    one; all rows of the query's id are its own. Ties go to the smaller vec_id.
    An empty table gives an empty result.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("key", F.xxhash64("vector")).withColumn("key2", F.xxhash64(F.lit(1), "vector"))
    rows = staged(rows.dropDuplicates(["vec_id", "key", "key2"]))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("vector") == dimension)
    same = ["key", "key2"]

    smallest = Window.partitionBy(*same).orderBy("vec_id")
    numbered = rows.withColumn("order", F.row_number().over(smallest)).where(F.col("order") <= k + 1)
    members = staged(numbered.select(*same, "vec_id", "order", "vector"))
    points = members.where("order = 1").select(*same, "vector")
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", *same)
    asks = asking.select(*same).distinct()
    entries = points.select(*same, F.lit(False).alias("is_query"), "vector").union(
        points.join(asks, same, "left_semi").select(*same, F.lit(True), "vector")
    )
    n, n_asks = points.count(), asks.count()
    most = max(1024, BLOCK_BYTES // (8 * dimension))  # entries of a block
    ordered = _curves(entries, points, dimension)
    window, used = _window(ordered, points, asks, dimension, k, n + n_asks)
    size = min(most, window)
    reach = -(-window // size)
    seen = min(n, (2 * reach + 1) * size)
    ordered, block = ordered.where(F.col("curve") < used), F.floor(F.col("rank") / size)
    last = F.lit((n + n_asks) // size)
    blocks = F.sequence(F.greatest(block - reach, F.lit(0)), F.least(block + reach, last))
    parts = max(1, -(-n_asks * seen // (max(1, n) * ASKS)))  # of the queries that a block meets
    dealt = ordered.withColumn("block", F.explode(F.when(F.col("is_query"), blocks.cast("array<long>")).otherwise(F.array(block.cast("long")))))
    part = F.when(F.col("is_query"), F.array(F.pmod("key2", F.lit(parts)))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
    dealt = dealt.withColumn("part", F.explode(part)).select("curve", "block", "part", "rank", "is_query", *same, "vector")
    hits = dealt.groupBy("curve", "block", "part").applyInArrow(_searcher(dimension, k, window), "q long, q2 long, key long, key2 long, score double")

    once = hits.dropDuplicates(["q", "q2", "key", "key2"])
    first = members.where("order = 1").select(*same, F.col("vec_id").alias("least"))
    best = Window.partitionBy("q", "q2")
    top = once.join(first, same).withColumn("o", F.row_number().over(best.orderBy(F.desc("score"), "least"))).where(F.col("o") <= k + 1)
    named = top.select("q", "q2", *same, "score").join(members.select(*same, "vec_id"), same)
    named = named.withColumn("o", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("o") <= k + 1)
    lists = staged(named.select("q", "q2", "vec_id", "score"))
    answers = asking.select(F.col("vec_id").alias("query_id"), F.col("key").alias("q"), F.col("key2").alias("q2")).join(lists, ["q", "q2"])
    answers = answers.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
