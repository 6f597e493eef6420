"""The trie of conversations by their first turns, with totals of every subtree.

A node is a distinct sequence of first turns. Its key is the exclusive or of two
64-bit hashes of each turn with its position, so that a conversation's keys are
running values, which can be worked out in slices: a conversation may span any
number of tasks. That two different sequences get one key has a chance of about
nodes^2 / 2^128.

Totals come by parallel tree contraction. A rake takes all leaves away and adds
them to their parents; a compress takes all unary chains away, whose nodes find
the end of their chain and what lies before it by pointer doubling, one join a
round. The two in turn leave at most half of the leaves, so rounds are few at
any depth and any fan-out. Then the contracted nodes come back in reverse: the
total of a chain's node is its own part of the chain and the total of its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.ordering import ranked
from cadenza.session import parallelism, staged

#: Turns of another conversation that a rebuilt one can begin with, plus one; who lends them.
LENT = 6
LENDERS = 100
TIE = 64  # characters of a text by which turns of equal number and role are ordered
PIECE = 4096  # ids that are joined to one string at a time
KEY = ["depth", "key1", "key2"]


# ---- turns


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (its place from 0), h1 and h2 (hashes of role and text), size (code points of the text).

    Turns go by their number, those without one first; equal ones by role, by
    the text's first 64 characters, then by hash. Rows without a conv_id belong
    to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    rows = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, TIE).alias("begin"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
        F.char_length("text").cast("long").alias("size"),
    )
    placed = ranked(rows, ["conv_id", "turn", "role", "begin", "h1", "h2"], "place").select("conv_id", "place", "h1", "h2", "size")
    return staged(placed)


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turns) and their turns after rebuilding: the first h of the lender's, then their own from h on.

    h is the unsigned crc32 of the decimal conv_id modulo 6, the lender is
    conv_id - conv_id % 100. A lender lends itself its own turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % LENT
    convs = own.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", h).withColumn("lender", F.col("conv_id") - F.col("conv_id") % LENDERS)
    lenders = convs.where("conv_id = lender").select(F.col("conv_id").alias("lender"), F.col("n").alias("has"), F.col("first").alias("lent"))
    convs = convs.join(lenders, "lender", "left")
    convs = staged(convs.withColumn("b", F.least("h", F.coalesce("has", F.lit(0)))))
    kept = own.join(convs.select("conv_id", "first", "h", "b"), "conv_id").withColumn("at", F.col("place") - F.col("first"))
    kept = kept.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("b")).alias("at"), "h1", "h2", "size")
    # At most five turns of each lender, by their place in the one order of all turns.
    asked = convs.where("b > 0").select(F.col("conv_id"), F.explode(F.sequence("lent", F.col("lent") + F.col("b") - 1)).alias("place"), "lent")
    heads = asked.join(own.drop("conv_id"), "place").select("conv_id", (F.col("place") - F.col("lent")).alias("at"), "h1", "h2", "size")
    lengths = convs.select("conv_id", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    return lengths, kept.unionByName(heads)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of every turn and of the turn before, as far as this task's part of the conversation gives them."""
    part = TaskContext.get().partitionId()
    last, carry = None, (0, 0)
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        head = np.ones(len(conv), bool)
        head[1:] = conv[1:] != conv[:-1]
        head[0] = last != int(conv[0])
        starts = np.flatnonzero(head)
        which = np.cumsum(head)
        columns = []
        for k in (0, 1):
            own = batch.column(2 + k).to_numpy()
            total = np.bitwise_xor.accumulate(own)
            before = np.concatenate(([0], total))[starts]  # all of the batch before each conversation that starts in it
            base = np.concatenate(([carry[k]], before))[which]
            run = total ^ base
            columns += [run, run ^ own]
        last, carry = int(conv[-1]), (int(columns[0][-1]), int(columns[2][-1]))
        run1, was1, run2, was2 = (pa.array(c, pa.int64()) for c in columns)
        at = batch.column(1)
        yield pa.record_batch(
            [pa.array(np.full(len(conv), part, np.int64)), batch.column(0), at, run1, run2, was1, was2, batch.column(4)], names=_STEP
        )


_STEP = ["part", "conv_id", "at", "key1", "key2", "was1", "was2", "size"]


def steps(lengths: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, key1, key2, was1, was2 (the parent's key), size and ends, per conversation and node other than the root."""
    own = [F.xxhash64(F.lit(k), "at", f"h{k}").alias(f"h{k}") for k in (1, 2)]
    dealt = rows.select("conv_id", "at", *own, "size")
    dealt = dealt.repartitionByRange(parallelism(rows.sparkSession), "conv_id", "at").sortWithinPartitions("conv_id", "at")
    ran = staged(dealt.mapInArrow(_running, ", ".join(f"{name} long" for name in _STEP)))
    # A task's first and last conversation may go on elsewhere: a few rows per task.
    edges = ran.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edges = edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"), "part")
    broken = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    pieces = ran.join(F.broadcast(broken.select("conv_id")), "conv_id").groupBy("conv_id", "part")
    # The key at the last turn of a part is the exclusive or of the part.
    pieces = pieces.agg(F.max_by("key1", "at").alias("all1"), F.max_by("key2", "at").alias("all2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"all{k}").over(earlier), F.lit(0)).alias(f"from{k}") for k in (1, 2)])
    whole = ran.join(F.broadcast(carried), ["conv_id", "part"], "left")
    keys = [F.col(name).bitwiseXOR(F.coalesce(f"from{name[-1]}", F.lit(0))).alias(name) for name in ("key1", "key2", "was1", "was2")]
    whole = whole.select("conv_id", (F.col("at") + 1).alias("depth"), *keys, "size")
    return staged(whole.join(lengths, "conv_id").withColumn("ends", F.col("depth") == F.col("turns")).drop("turns"))


# ---- nodes


def nodes(lengths: DataFrame, path: DataFrame) -> DataFrame:
    """node (a number), depth, key1, key2, parent, conv_id, parent_conv_id, n_convs and saved, one row per node."""
    grouped = path.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("was1").alias("was1"), F.min("was2").alias("was2"), F.min("size").alias("size"),
    )
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "conv_id", "n_convs", *[F.lit(None).cast("long").alias(n) for n in ("was1", "was2")], zero.alias("size"))
    numbered = staged(grouped.unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    above = numbered.select(
        (F.col("depth") + 1).alias("depth"), F.col("key1").alias("was1"), F.col("key2").alias("was2"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    # Only nodes of equal depth and key meet, so a busy parent is one row on the other side.
    found = numbered.join(above, ["depth", "was1", "was2"], "left")
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    return staged(found.select("node", *KEY, "parent", "conv_id", "parent_conv_id", "n_convs", saved))


# ---- contraction

_SUMS = ["leaves", "saved"]
#: What chains taken out between a node and its parent added up to: it goes to the parent along with the node's total.
_LIFTS = [f"lift_{s}" for s in _SUMS]


def _rake(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their totals, and the other nodes with what their leaves gave them and the children they have left."""
    kids = alive.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    marked = staged(alive.join(kids, "node", "left"))
    leaves = marked.where("kids is null")
    given = leaves.where("parent is not null").groupBy(F.col("parent").alias("node"))
    given = given.agg(F.count(F.lit(1)).alias("raked"), *[F.sum(F.col(s) + F.col(up)).alias(f"given_{s}") for s, up in zip(_SUMS, _LIFTS, strict=True)])
    rest = marked.where("kids is not null").join(given, "node", "left")
    sums = [(F.col(s) + F.coalesce(f"given_{s}", F.lit(0))).alias(s) for s in _SUMS]
    rest = rest.select("node", "parent", *sums, *_LIFTS, (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"))
    return leaves.select("node", *_SUMS), staged(rest)


def _compress(rest: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Chains (node, end, and the sums from the node up to the end) and the tree without their nodes."""
    unary = rest.where("kids = 1")
    child = rest.select(F.col("node").alias("end"), F.col("parent").alias("node"), (F.col("kids") == 1).alias("open"), *_LIFTS)
    first = unary.select("node", *_SUMS).join(child, "node")
    whole = staged(first.select("node", *[(F.col(s) + F.col(up)).alias(s) for s, up in zip(_SUMS, _LIFTS, strict=True)], "end", "open"))
    if whole.isEmpty():
        return None, rest.drop("kids")
    while not whole.where("open").isEmpty():
        # Every open link jumps to where its end points: the distance to the chain's end halves.
        on = whole.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("open").alias("still"), *[F.col(s).alias(f"more_{s}") for s in _SUMS])
        jumped = whole.where("open").join(on, "end")
        jumped = jumped.select("node", *[(F.col(s) + F.col(f"more_{s}")).alias(s) for s in _SUMS], F.col("next").alias("end"), F.col("still").alias("open"))
        whole = staged(whole.where("not open").unionByName(jumped))
    return whole.drop("open"), _spliced(rest, unary, whole)


def _spliced(rest: DataFrame, unary: DataFrame, chains: DataFrame) -> DataFrame:
    """The nodes that are not unary, those at a chain's end under the parent of the chain's top, with the chain's sums as their lift.

    The top is the one node of a chain whose parent is not unary.
    """
    of_unary = unary.select(F.col("node").alias("parent"))
    below = unary.join(of_unary, "parent", "left_semi").select("node")
    tops = unary.select("node", F.col("parent").alias("over"), *_LIFTS).join(below, "node", "left_anti")
    sums = [(F.col(s) + F.col(up)).alias(f"chain_{s}") for s, up in zip(_SUMS, _LIFTS, strict=True)]
    moved = tops.join(chains, "node").select(F.col("end").alias("node"), "over", *sums, F.lit(True).alias("moved"))
    left = rest.where("kids <> 1").join(moved, "node", "left")
    lifts = [F.when(F.col("moved"), F.col(f"chain_{s}")).otherwise(F.col(up)).alias(up) for s, up in zip(_SUMS, _LIFTS, strict=True)]
    return left.select("node", F.when(F.col("moved"), F.col("over")).otherwise(F.col("parent")).alias("parent"), *_SUMS, *lifts)


def contract(tree: DataFrame) -> DataFrame:
    """node and the sums of `leaves` and `saved` over its subtree, for a forest of node, parent, leaves, saved."""
    alive = staged(tree.select("node", "parent", *_SUMS, *[F.lit(0).cast("long").alias(up) for up in _LIFTS]))
    raked, chains = [], []
    while not alive.isEmpty():
        leaves, rest = _rake(alive)
        links, alive = _compress(rest)
        raked.append(leaves)
        chains.append(links)
        alive = staged(alive)
    totals = None
    for leaves, links in zip(reversed(raked), reversed(chains), strict=True):
        if links is not None and totals is not None:
            ends = totals.select(F.col("node").alias("end"), *[F.col(s).alias(f"more_{s}") for s in _SUMS])
            back = links.join(ends, "end").select("node", *[(F.col(s) + F.col(f"more_{s}")).alias(s) for s in _SUMS])
            totals = staged(totals.unionByName(back))
        totals = leaves if totals is None else totals.unionByName(leaves)
    return tree.select("node", *_SUMS) if totals is None else totals


# ---- digests of the conversations that end at a node

_DIGEST = "depth long, key1 long, key2 long, part long, seq long, ids string, sha string"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, names=[x.split(" ")[0] for x in _DIGEST.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of small groups that lie within this task, strings of at most PIECE ids of the others.

    The task's first group may have begun in an earlier one, its last may go on.
    """
    part, seq = TaskContext.get().partitionId(), 0
    group, held, first, opened = None, [], True, False
    out: list[tuple] = []

    def string() -> str:
        return ",".join(str(i) for ids in held for i in ids.tolist())

    def leave(open_end: bool) -> None:
        nonlocal seq
        if held:
            whole = not (first or opened or open_end)
            out.append((*group, part, seq, *((None, hashlib.sha256(string().encode()).hexdigest()) if whole else (string(), None))))
            seq += 1
            held.clear()

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        ids = batch.column(3).to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if low == high:
                continue
            own = tuple(keys[low].tolist())
            if own != group:
                leave(open_end=False)
                first = group is None
                group, opened = own, False
            for at in range(low, high, PIECE):
                if sum(map(len, held)) + min(PIECE, high - at) > PIECE:
                    leave(open_end=True)
                    opened = True
                held.append(ids[at : min(at + PIECE, high)])
        if out:
            yield _record(out)
            out.clear()
    leave(open_end=True)
    if out:
        yield _record(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of groups from their strings, which come in order; one string is held at a time."""
    group, sha = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != group:
                if group is not None:
                    done.append((*group, sha.hexdigest()))
                group, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _shas(done)
    if group is not None:
        yield _shas([(*group, sha.hexdigest())])


def _shas(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "sha"])


def ends(lengths: DataFrame, path: DataFrame) -> DataFrame:
    """KEY and the hex SHA-256 of the ids of the conversations that end there, ascending and comma-joined.

    A digest of one string is sequential work; what goes to one task of it is
    strings of thousands of ids, joined in parallel, held one at a time.
    """
    zero = F.lit(0).cast("long")
    bare = lengths.where("turns = 0").select(*[zero.alias(k) for k in KEY], "conv_id")
    last = path.where("ends").select(*KEY, "conv_id").unionByName(bare)
    parts = parallelism(path.sparkSession)
    dealt = last.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    found = staged(dealt.mapInArrow(_joined, _DIGEST))
    pieces = found.where("sha is null").repartition(parts, *KEY).sortWithinPartitions(*KEY, "part", "seq")
    rest = pieces.select(*KEY, "ids").mapInArrow(_hashed, "depth long, key1 long, key2 long, sha string")
    return found.where("sha is not null").select(*KEY, "sha").unionByName(rest)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; turns that repeat are turns of their
    own; other columns have no part. Texts of any length are hashed whole where
    they are read and go no further. A table without conversations has no nodes,
    not even a root.
    """
    lengths, rows = rebuilt(turns(conversations))
    path = steps(lengths, rows)
    every = nodes(lengths, path)
    kids = every.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    every = staged(every.join(kids, "node", "left").fillna(0, ["n_children"]))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")
    totals = contract(every.select("node", "parent", leaf, "saved"))
    totals = totals.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    empty = hashlib.sha256(b"").hexdigest()
    found = every.drop("saved").join(totals, "node").join(ends(lengths, path), KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(empty)).alias("ends_sha256"),
    )
