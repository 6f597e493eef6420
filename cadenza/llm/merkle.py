"""A Merkle tree over the rows of a table: per source, then over the sources.

Where a leaf stands among its source's leaves is a rank query, not a sort. The
ids of a source are merged into bitmaps of 32,768 ids each. A directory of
popcounts, over the containers of a source and over each 64 bytes of a container,
gives the number of smaller ids. The compression is that of Spark's shuffles and
of Parquet, which shrink runs of zero bytes. Containers in which ids repeat or
are missing cannot be ranked by bits alone; their rows are numbered in one
range-partitioned order, however many they are.

From then on every level is a grouping on (source, coordinate / 16): a run is an
array of at most 16 slots keyed by its parent, whose hash is a node of the next
level, with a sixteenth of the rows. Proofs come down the same runs: a node's
path is its own slot's neighbours, then the path of its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.ordering import ranked, running_totals
from cadenza.session import staged

ARITY = 16
SHIFT = 4  # ARITY is 1 << SHIFT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CONTAINER = 15  # bits of an id that say where in its container it is
BLOCK = 64  # bytes of a container that one entry of its popcount directory covers
NO_ID = -(1 << 60)  # the container of rows without an id, before all others
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each with its length in front, so that no two rows read alike."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf after tampering where the row is tampered with (else null)."""
    values = [F.col(name) for name in FIELDS]
    bent = [*values[:-1], F.translate("text", _UPPER, _LOWER)]
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return docs.select("doc_id", "source", leaf_hash(values).alias("leaf"), F.when(chosen, leaf_hash(bent)).alias("tampered"))


def containers(rows: DataFrame) -> DataFrame:
    """Per source and container: bitmap of its ids, popcounts before each block, rows, and rows of the containers before."""
    spot = F.col("doc_id").bitwiseAND(F.lit((1 << CONTAINER) - 1))
    merged = rows.groupBy("source", _container().alias("container"))
    merged = staged(merged.agg(F.bitmap_construct_agg(spot).alias("bits"), F.count(F.lit(1)).alias("rows")))
    before = running_totals(merged.select("source", "container", "rows"), ["source"], ["container"], "rows", "before")
    return _on(merged, before.select("source", "container", "before", F.col("total").alias("n")), ["source", "container"])


def _container() -> Column:
    return F.coalesce(F.shiftright("doc_id", CONTAINER), F.lit(NO_ID))


def _directory() -> Column:
    """How many ids a container holds before each of its blocks."""
    counts = F.expr(f"transform(sequence(0, {(1 << CONTAINER) // 8 // BLOCK - 1}), i -> bitmap_count(substring(bits, i * {BLOCK} + 1, {BLOCK})))")
    return F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))


#: Ids of a container that are smaller than `doc_id`: a directory entry, the rest of its block, the bits of one byte.
_RANK = f"""
    popcounts[spot div {8 * BLOCK}]
    + bitmap_count(substring(bits, spot div {8 * BLOCK} * {BLOCK} + 1, spot div 8 % {BLOCK}))
    + bit_count(conv(hex(substring(bits, spot div 8 + 1, 1)), 16, 10)::int & (shiftleft(1, spot % 8) - 1))
"""


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the columns of the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def coordinates(rows: DataFrame) -> DataFrame:
    """The rows with `at`, their place from 0 among the rows of their source, and `n`, the source's rows.

    Rows without a doc_id come first. Rows that agree in source and doc_id
    follow each other in the order of their leaves; of equal rows each has a
    place of its own.
    """
    held = staged(containers(rows).withColumn("popcounts", _directory()).withColumn("plain", F.col("rows") == F.bitmap_count("bits")))
    placed = _on(rows.withColumn("container", _container()), held.where("plain"), ["source", "container"])
    placed = placed.withColumn("spot", F.col("doc_id").bitwiseAND(F.lit((1 << CONTAINER) - 1)).cast("int"))
    columns = [*rows.columns, "n"]
    ranks = placed.select(*columns, (F.col("before") + F.expr(_RANK)).alias("at"))
    crowded = held.where("not plain").select("source", "container", "before", "n")
    if crowded.isEmpty():
        return ranks
    again = _on(rows.withColumn("container", _container()), crowded, ["source", "container"])
    again = ranked(again, ["source", "doc_id", "leaf"], "place")
    first = again.groupBy("source", "container").agg(F.min("place").alias("first"))
    again = _on(again, first, ["source", "container"])
    return ranks.union(again.select(*columns, (F.col("before") + F.col("place") - F.col("first")).alias("at")))


def _runs(nodes: DataFrame, *values: str) -> DataFrame:
    """Slot arrays of a level, keyed by group and parent; members in slot order."""
    run = F.shiftright("at", SHIFT).alias("run")
    members = F.array_sort(F.collect_list(F.struct("at", *values))).alias("members")
    return nodes.groupBy("group", run).agg(F.first("n").alias("n"), members)


def _parents(runs: DataFrame, digest: str = "digest") -> DataFrame:
    """The nodes above; a group of one node is its own root and is not hashed again."""
    joined = F.array_join(F.transform("members", lambda m: m[digest]), "")
    own = F.when(F.col("n") == 1, F.col("members")[0][digest]).otherwise(F.sha2(joined, 256))
    return runs.select("group", F.col("run").alias("at"), F.ceil(F.col("n") / ARITY).alias("n"), own.alias("digest"))


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of all levels from the given nodes up, and (group, digest) of every group's root.

    `nodes` has group, at, n and digest; `most` is the largest n. Each level is
    written to the shared folder, so a lost executor costs one level.
    """
    levels, tops = [], nodes.where("n = 1").select("group", "digest")
    while most > 1:
        levels.append(staged(_runs(nodes.where("n > 1"), "digest")))
        nodes = _parents(levels[-1])
        tops = tops.union(nodes.where("n = 1").select("group", "digest"))
        most = -(-most // ARITY)
    return levels, tops


def _beside(digest: str, values: tuple[str, ...] = ()) -> Column:
    """Per member of a run: `at`, the other values, and the digests left and right of it in one string each."""

    def one(m: Column, i: Column) -> Column:
        left = F.array_join(F.transform(F.slice("members", F.lit(1), i), lambda x: x[digest]), "")
        right = F.array_join(F.transform(F.slice("members", i + 2, F.lit(ARITY)), lambda x: x[digest]), "")
        return F.struct(m["at"].alias("at"), *[m[v].alias(v) for v in values], left.alias("left"), right.alias("right"))

    return F.transform("members", one)


def _above(runs: DataFrame, paths: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Runs with the path and subroot of their node: the group's own where that node is its root, else those on the level above."""
    last = F.ceil(F.col("n") / ARITY) == 1
    found = _on(runs.where(last), tops, ["group"])
    if paths is None:
        return found
    rest = _on(runs.where(~last), paths.withColumnRenamed("at", "run"), ["group", "run"])
    return found.unionByName(rest)


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """group, at, path and subroot of every node of the lowest level, from the (group, path, subroot) of the groups' roots."""
    paths = None
    for runs in reversed(levels):
        found = _above(runs, paths, tops).withColumn("m", F.explode(_beside("digest")))
        step = F.array(F.struct("m.left", "m.right"))
        paths = found.select("group", F.col("m.at").alias("at"), F.concat(step, "path").alias("path"), "subroot")
    return paths


_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs`.

    Leaves are hashes of doc_id, source, lang, n_chars and text; other columns
    have no part, whatever their names. A null differs from an empty value.
    Rows of a source ascend by doc_id, those without one first; sources ascend
    bytewise, null first. Repeated rows are leaves of their own. Texts of any
    length are hashed whole where they are read. A row without a doc_id is never
    tampered with. An empty table has an empty manifest.
    """
    rows = staged(leaves(docs))
    placed = coordinates(rows).withColumnRenamed("source", "group")
    own = ("doc_id", "leaf", "tampered")
    ground = staged(_runs(placed, *own))
    nodes = _parents(ground, "leaf")
    most = ground.agg(F.max("n")).first()[0]
    if most is None:
        return _empty(docs)
    levels, tops = climb(nodes, -(-most // ARITY))
    subroots = staged(ranked(tops.withColumnRenamed("digest", "subroot"), ["group"], "place"))

    sources = subroots.count()
    first = subroots.select(F.lit(0).alias("group"), F.col("place").alias("at"), F.lit(sources).cast("long").alias("n"), F.col("subroot").alias("digest"))
    upper, top = climb(first, sources)
    root = top.first()["digest"]
    none = F.array().cast(_PATH).alias("path")
    if upper:
        over = descend(upper, top.select("group", none, F.lit(None).alias("subroot")))
        heads = subroots.join(over.select(F.col("at").alias("place"), "path"), "place").select("group", "path", "subroot")
    else:
        heads = subroots.select("group", none, "subroot")
    heads = staged(heads)

    found = _above(ground, descend(levels, heads), heads)
    members = found.withColumn("m", F.explode(_beside("leaf", own)))
    step = F.array(F.struct("m.left", "m.right"))
    path = F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path"))
    members = members.select("m.doc_id", "m.leaf", "m.tampered", "subroot", path.alias("path"))
    beside = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    fold = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))
    out = members.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.sha2(beside, 256).alias("proof_sha256"), fold.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _empty(docs: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return docs.limit(0).select("doc_id", *[text.alias(n) for n in names], F.lit(None).cast("boolean").alias("verified"))
