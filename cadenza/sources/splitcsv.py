"""One large CSV over many tasks, also where quoted cells hold line breaks.

Spark's text reader hands out a file's lines by byte ranges. What a range does
not know is whether it begins inside a quoted cell. So a first pass works out,
for each range, whether a cell is open at its end under either assumption; these
functions are chained per file over one row per range. The second pass then cuts
records at true line ends. A record that crosses ranges is put together from one
piece per range; all others never leave their task. Cells are parsed by Spark.

Files without a quoted line break need no second pass of this kind: Spark's own
reader splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.joins import lookup
from cadenza.session import isolated, staged

CSV_CELLS = {"header": True, "escape": '"'}
WHOLE, TAIL, HEAD = 0, 1, 2  # kinds of pieces: a record, the beginning of one, the rest of one


def listing(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and length of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "length")


def file_path() -> Column:
    """The path of the file a row comes from, as a reader takes it: Spark's metadata has it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def range_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads."""
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value (as bytes), path and from_byte: the lines of the files, in order within each byte range.

    Ranges must be the same whenever the files are read, so their size does not
    follow the number of cores that happen to be there.
    """
    child = isolated(spark)
    child.conf.set("spark.sql.files.minPartitionNum", "1")
    child.conf.set("spark.sql.files.openCostInBytes", "0")
    text = child.read.text(paths, lineSep="\n")
    return text.select(F.col("value").cast("binary").alias("value"), file_path().alias("path"), F.col("_metadata.file_block_start").alias("from_byte"))


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at a line's end, given whether one is at its start.

    A quote opens a cell only at the cell's beginning; within, two stand for one.
    """
    if inside:
        at = 0
    elif line[:1] == b'"':
        at = 1
    elif (at := line.find(b',"') + 2) == 1:
        return False
    while True:
        close = line.find(b'"', at)
        if close < 0:
            return True
        if line[close + 1 : close + 2] == b'"':
            at = close + 2
        elif (at := line.find(b',"', close) + 2) == 1:
            return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Rows of each byte range in a batch: columns file and from_byte come first."""
    file, begin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = [0, *(((file[1:] != file[:-1]) | (begin[1:] != begin[:-1])).nonzero()[0] + 1).tolist(), len(file)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low < high:
            yield (int(file[low]), int(begin[low])), batch.slice(low, high - low)


_RANGE = "file long, from_byte long, after_closed boolean, after_open boolean, breaks_closed boolean, breaks_open boolean, odd boolean"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range: what is open at its end under both assumptions, and whether any cell had a line break."""
    names = [x.split(" ")[0] for x in _RANGE.split(", ")]
    place, state, breaks, odd = None, [False, True], [False, True], False

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v]) for v in (*place, *state, *breaks, odd)], names=names)

    for batch in batches:
        for own, rows in _runs(batch):
            if own != place:
                if place is not None:
                    yield row()
                place, state, breaks, odd = own, [False, True], [False, True], False
            odd = odd or bool(pc.any(rows.column(3)).as_py())
            for line in rows.column(2).drop_null():
                text = line.as_py()
                for k in (0, 1):
                    state[k] = open_after(text, state[k])
                    breaks[k] = breaks[k] or state[k]
    if place is not None:
        yield row()


def ranges(rows: DataFrame) -> DataFrame:
    """Per byte range: file, from_byte, `inside` (whether it begins in a quoted cell), `plain` (no line break in a cell, nothing odd)."""
    quoted = F.when(F.contains("value", F.lit(b'"')), F.col("value"))
    # A return within a line, or a line of blanks, is not what Spark's line reader and its record reader agree on.
    text = F.col("value").cast("string")
    odd = text.rlike("\r[^\r]") | text.rlike("^[ \t]+\r?$")
    seen = rows.select(F.xxhash64("path").alias("file"), "from_byte", quoted.alias("quoted"), odd.alias("odd"))
    found = staged(seen.mapInArrow(_profile, _RANGE))
    # A range keeps the state, sets it or turns it round; a set state is carried over the turns after it.
    turns = F.when(F.col("after_closed") & ~F.col("after_open"), 1).otherwise(0)
    so_far = W.partitionBy("file").orderBy("from_byte")
    found = found.withColumn("turns", F.sum(turns).over(so_far) % 2)
    put = F.when(F.col("after_closed") == F.col("after_open"), F.col("after_closed").cast("int").bitwiseXOR(F.col("turns").cast("int")))
    earlier = so_far.rowsBetween(W.unboundedPreceding, -1)
    state = F.coalesce(F.last(put, ignorenulls=True).over(earlier), F.lit(0))
    turned = F.coalesce(F.lag("turns").over(so_far), F.lit(0)).cast("int")
    found = found.withColumn("inside", state.bitwiseXOR(turned) == 1)
    broken = F.when(F.col("inside"), F.col("breaks_open")).otherwise(F.col("breaks_closed"))
    return found.select("file", "from_byte", "inside", (~broken & ~F.col("inside") & ~F.col("odd")).alias("plain"))


_PIECE = "file long, from_byte long, kind int, first boolean, value binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each byte range, and what begins in an earlier one or goes on in a later one."""
    names = [x.split(" ")[0] for x in _PIECE.split(", ")]
    place, inside, held, start, first = None, False, [], False, False

    def piece(kind: int, values, first: bool) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([v] * n, t) for v, t in ((place[0], pa.int64()), (place[1], pa.int64()), (kind, pa.int32()), (first, pa.bool_()))]
        return pa.record_batch([*columns, values if isinstance(values, pa.Array) else pa.array(values, pa.binary())], names=names)

    def record(closed: bool) -> pa.RecordBatch:
        """What is held: a record, or the beginning, the rest or the middle of one."""
        nonlocal held, first
        kind = HEAD if not start else WHOLE if closed else TAIL
        out = piece(kind, [b"\n".join(held)], first and start)
        first, held = first and not start, []
        return out

    for batch in batches:
        for own, rows in _runs(batch):
            if own != place:
                if held:
                    yield record(closed=False)
                place, first = own, own[1] == 0
                inside = rows.column(2)[0].as_py()
                start, held = False, []
            texts = rows.column(3)
            marked = pc.indices_nonzero(pc.match_substring(texts, '"')).to_pylist()
            at = 0
            for stop in [*marked, len(texts)]:
                if inside:
                    held += texts.slice(at, stop - at).to_pylist()
                elif stop > at:
                    if first:
                        yield piece(WHOLE, texts.slice(at, 1), True)
                        first, at = False, at + 1
                    if stop > at:
                        yield piece(WHOLE, texts.slice(at, stop - at), False)
                if stop == len(texts):
                    break
                line = texts[stop].as_py()
                if not inside:
                    start = True
                held.append(line)
                inside = open_after(line, inside)
                if not inside:
                    yield record(closed=True)
                at = stop + 1
    if held:
        yield record(closed=False)


def records(rows: DataFrame, found: DataFrame) -> DataFrame:
    """file and value: the text of every record but each file's first, its header."""
    keyed = rows.select(F.xxhash64("path").alias("file"), "from_byte", "value").withColumn("at", F.monotonically_increasing_id())
    # One row per byte range. Where that is too much to broadcast, lines go to their range's task and back in order.
    known = lookup(found.select("file", "from_byte", "inside"), row_bytes=24)
    joined = keyed.join(known, ["file", "from_byte"])
    if not _broadcast(known):
        joined = joined.repartition("file", "from_byte").sortWithinPartitions("file", "from_byte", "at")
    pieces = staged(joined.select("file", "from_byte", "inside", "value").mapInArrow(_pieces, _PIECE))
    whole = pieces.where(f"kind = {WHOLE} and not first").select("file", "value")
    # At most a piece before the first record of a range and one after its last.
    parts = pieces.where(f"kind <> {WHOLE}").withColumn("turn", F.when(F.col("kind") == HEAD, 0).otherwise(1))
    number = F.sum("turn").over(W.partitionBy("file").orderBy("from_byte", "turn"))
    sewn = parts.withColumn("number", number).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("from_byte", "turn", "value"))).alias("parts"), F.max("first").alias("first")
    )
    value = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), "\n")
    whole = whole.withColumn("value", F.col("value").cast("string"))
    return whole.unionByName(sewn.where("not first").select("file", value.alias("value")))


def _broadcast(frame: DataFrame) -> bool:
    return frame._jdf.queryExecution().analyzed().getClass().getSimpleName() == "ResolvedHint"


def read_split(spark: SparkSession, paths: list[str], names: list[str], crlf: bool, path_column: str | None) -> DataFrame:
    """Rows of large files with one header, every column a string, and `path_column` with the file's path if named.

    `names` are the header's columns; `crlf` tells whether lines end with a
    return as well, which then is no part of a cell.
    """
    rows = lines(spark, paths)
    found = ranges(rows)
    plain = found.groupBy("file").agg(F.min("plain").alias("plain"))
    files = listing(spark, paths).select("path", F.xxhash64("path").alias("file")).join(plain, "file")
    easy = {r["path"]: r["plain"] for r in files.collect()}  # one row per large file
    parts = []
    if simple := [path for path, is_plain in easy.items() if is_plain]:
        own = spark.read.options(**CSV_CELLS).csv(simple)
        parts.append(own.select("*", *_path(file_path(), path_column)))
    if broken := [path for path, is_plain in easy.items() if not is_plain]:
        text = records(lines(spark, broken), found)
        value = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", "") if crlf else F.col("value")
        text = text.withColumn("value", F.make_valid_utf8(value)).where("value <> ''")
        cells = F.from_csv("value", ", ".join(f"c{k} string" for k in range(len(names))), {"escape": '"'}).alias("cells")
        named = [F.col(f"cells.c{k}").alias(name) for k, name in enumerate(names)]
        if path_column:
            known = lookup(listing(spark, broken).select(F.xxhash64("path").alias("file"), "path"), row_bytes=24)
            text = text.join(known, "file")
        text = text.select(cells, *(["path"] if path_column else []))
        parts.append(text.select(*named, *_path(F.col("path"), path_column)))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _path(path: Column, name: str | None) -> list[Column]:
    return [path.alias(name)] if name else []
