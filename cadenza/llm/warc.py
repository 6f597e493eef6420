"""WARC archives of pages, and their index as one merge of sorted runs.

Records are rows of text, so Spark's own writer makes the archives: the record
with all its header lines is one value, and the writer ends each with the two
line breaks that end a WARC record. What is committed is whole files, also when
a task is lost and runs again. Reading takes records apart by Content-Length.

Every archive gives one run of index entries, sorted where it was read. Ranges
of the URL key and timestamp are cut once; each range takes its part of every
run, and the runs are merged by a loser tree, which compares one entry per level
for each it puts out. Ranges follow each other, so all captures are in one
global order: the history of each URL.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import drop_at_exit, parallelism, shared_path, staged

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Records of an archive at most: a task reads an archive whole.
RECORDS = 4096
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """40 hex digits in upper-case base32, five digits at a time."""
    letters = F.lit(_BASE32)
    out = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", ts_column: str | None = None) -> DataFrame:
    """The capture of each row: page_id, url, ts, payload, bytes, sha, record_type and refers_to.

    Of captures with equal payloads of at least `least` bytes the one with the
    smallest page_id is the response, the others revisit it. A null html is an
    empty payload. A row without a page_id revisits a response that has one; all
    are responses where none has. Rows that repeat the smallest page_id are
    responses too. Without a timestamp column a page's time is its id in seconds
    after 2024-01-01.
    """
    start = 1704067200
    ts = F.col(ts_column) if ts_column else F.timestamp_seconds(F.lit(start) + F.coalesce(F.pmod(F.col(id_column), F.lit(1 << 31)), F.lit(0)))
    payload = F.coalesce(F.col(html_column), F.lit(""))
    # Control characters cannot stand in a header line.
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(url_column), "\r", "%0D"), "\n", "%0A"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    rows = pages.select(F.col(id_column).alias("page_id"), url.alias("url"), ts.alias("ts"), payload.alias("payload"))
    sha = F.sha1(F.encode("payload", "UTF-8"))
    rows = rows.withColumn("sha", sha).withColumn("bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, ["sha", "bytes"], "left")
    again = F.coalesce((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def _text(records: DataFrame) -> Column:
    """A record as text, without the line breaks that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(http, "payload")).otherwise(http)

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))

    key = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", key),
        line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        line("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(~response, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block)),
    )
    return F.concat(head, F.lit(END), block)


def write_archives(records: DataFrame, path: str | None = None) -> str:
    """Write the records as WARC files under `path`, or a new folder all executors share.

    Files are compressed as one stream each; offsets in the index count the
    bytes of the stream.
    """
    spark = records.sparkSession
    target = path or shared_path(spark, "warc")
    lines = records.select(_text(records).alias("value"))
    lines.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=RECORDS).text(target)
    if path is None:
        drop_at_exit(spark, target)
    return target


def _parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header lines and block of each record."""
    at = 0
    while at < len(data):
        stop = data.index(END.encode(), at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        yield at, fields, data[begin:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """Host names from the top down, then the path and query: captures of a site stay together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    host = host.removeprefix("www.")
    rest = parts.path.rstrip("/").lower() + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


_ENTRY = "run string, url_key string, ts string, url string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"
_NAMES = [part.split(" ")[0] for part in _ENTRY.split(", ")]


def _page(field: str | None) -> int | None:
    inner = field.removeprefix("<urn:page:").removesuffix(">") if field else "none"
    return None if inner == "none" else int(inner)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of index entries per archive; payload digests are worked out anew."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            run = []
            data = content.as_buffer().to_pybytes()
            for at, fields, block in _parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = None
                if fields["WARC-Type"] == "response":
                    payload = block[block.index(END.encode()) + 4 :]
                    own, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    if own != digest:
                        raise ValueError(f"damaged payload at byte {at} of {path}")
                url = fields.get("WARC-Target-URI")
                key, ts = url_key(url), fields["WARC-Date"]
                run.append((path.as_py(), key, ts, url, _page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), size, digest, at, len(block)))
            run.sort(key=_order)
            schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (p.split(" ") for p in _ENTRY.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run, strict=True) if run else [()] * len(_NAMES), schema, strict=True)], schema=schema)


def _order(entry: tuple) -> tuple:
    return entry[1].encode(), entry[2], entry[4] is None, entry[4] or 0, entry[0], entry[9]


def loser_tree(runs: list[list], key) -> Iterator:
    """Sorted runs as one: inner nodes keep the loser of their match, the winner of all comes out."""
    k = len(runs)
    if not k:
        return
    heads = [0] * k
    keys = [key(run[0]) if run else None for run in runs]

    def wins(a: int, b: int) -> bool:
        if keys[b] is None or keys[a] is None:
            return keys[b] is None
        return keys[a] <= keys[b]

    tree = [-1] * k
    winner = -1
    for leaf in range(k):  # leaves wait at the first free node on their way up
        at, player = (leaf + k) // 2, leaf
        while at and tree[at] != -1:
            if wins(tree[at], player):
                tree[at], player = player, tree[at]
            at //= 2
        if at:
            tree[at] = player
        else:
            winner = player
    while keys[winner] is not None:
        yield runs[winner][heads[winner]]
        heads[winner] += 1
        keys[winner] = key(runs[winner][heads[winner]]) if heads[winner] < len(runs[winner]) else None
        at, player = (winner + k) // 2, winner
        while at:
            if wins(tree[at], player):
                tree[at], player = player, tree[at]
            at //= 2
        winner = player


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one range, which come in one after another, as one ordered run."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(entry[0], []).append(entry)
    part: list[tuple] = []
    for entry in loser_tree(list(runs.values()), _order):
        part.append(entry)
        if len(part) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures under `path` in order of URL key and timestamp, one history after another."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = staged(files.mapInArrow(_read, _ENTRY))
    # Spark cuts the ranges; within one, each run keeps the order it was read with.
    dealt = runs.repartitionByRange(parallelism(spark), "url_key", "ts", "page_id", "run", "offset")
    kept = dealt.sortWithinPartitions("run", "url_key", "ts", F.col("page_id").asc_nulls_last(), "offset")
    return kept.mapInArrow(_merge, _ENTRY)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the pages as archives and read them back.

    Per row: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    the place in the archives: url_key, ts, run, offset. A revisit has no payload
    of its own; its size is that of the response it refers to, found by digest.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = write_archives(records(pages, **columns))
    index = staged(read_index(spark, path))
    sizes = index.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    rows = index.join(sizes, "payload_digest")
    return rows.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url_key", "ts", "run", "offset")
