"""Reading reports and royalty tables, writing royalty tables and results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.schema import DATASET_ID, STORED_SCHEMA
from cadenza.session import isolated
from cadenza.sources.splitcsv import file_path, listing, range_bytes, read_split

CSV_READ = {"header": True, "multiLine": True, "escape": '"'}
CSV_WRITE = {"header": True, "escape": '"', "emptyValue": "", "nullValue": ""}


#: Bytes of a file by which its layout is told.
SNIPPET_BYTES = 1024
_HEAD = "path string, snippet binary, header string, line_end string"


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's first bytes and first line; the rest of the file is not asked for."""
    path, text, header = None, b"", None
    for batch in batches:
        for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            header = line if header is None else header
            path, text = own, text + line + b"\n"
            if len(text) >= SNIPPET_BYTES:
                break
        if len(text) >= SNIPPET_BYTES:
            break
    if path is not None:
        # A file whose lines end in a return alone is one line here.
        own = header.split(b"\r")[0]
        end = "\n" if own == header else "\r\n" if own + b"\r" == header else "\r"
        values = (path, text[:SNIPPET_BYTES], own.decode(errors="replace"), end)
        yield pa.record_batch([pa.array([v]) for v in values], names=[x.split(" ")[0] for x in _HEAD.split(", ")])


def heads(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, length, snippet (first bytes), header (first line) and line_end of every file below a folder, or of the given files.

    Read in tasks, one per file, each of which stops after the file's first
    lines; an empty file has an empty snippet and header.
    """
    listed = _listed(spark, paths) if paths else []  # one short row per file
    files = spark.createDataFrame(listed, "path string, length long")
    full = [path for path, length in listed if length]
    if not full:
        return files.select("*", F.lit(b"").alias("snippet"), F.lit("").alias("header"), F.lit("\n").alias("line_end"))
    child = isolated(spark)
    for setting in ("maxPartitionBytes", "openCostInBytes"):  # a file is never cut, nor read together with another
        child.conf.set(f"spark.sql.files.{setting}", str(1 << 60))
    child.conf.set("spark.sql.files.minPartitionNum", "1")
    text = child.read.text(full, lineSep="\n")
    found = text.select(file_path().alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(_first_lines, _HEAD)
    empty = [F.coalesce(name, F.lit(value)).alias(name) for name, value in (("snippet", b""), ("header", ""), ("line_end", "\n"))]
    return files.join(found, "path", "left").select("path", "length", *empty)


def _listed(spark: SparkSession, paths: list[str] | str) -> list[tuple[str, int]]:
    """Path and length of every file, empty ones too, which Spark's readers leave out; none where the folder is not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(paths if isinstance(paths, str) else paths[0])
    store = root.getFileSystem(conf)
    if not isinstance(paths, str):
        found = [store.getFileStatus(jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
        return [(f.getPath().toString(), f.getLen()) for f in found]
    if not store.exists(root):
        return []
    out, files, above = [], store.listFiles(root, True), len(store.makeQualified(root).toString())
    while files.hasNext():
        file = files.next()
        path = file.getPath().toString()
        if not any(part[:1] in ("_", ".") for part in path[above:].strip("/").split("/")):
            out.append((path, file.getLen()))
    return out


def processed_path(root: str, workspace_id: str) -> str:
    return f"{root.rstrip('/')}/workspaces/{workspace_id}/processed"


def staging_path(root: str, workspace_id: str) -> str:
    return f"{root.rstrip('/')}/workspaces/{workspace_id}/staging"


def read_report(spark: SparkSession, path: str | list[str], path_column: str | None = None) -> DataFrame:
    """Report rows, every column a string, so a UPC keeps its leading zeros; `path_column` names one for the file's path.

    Quoted cells may hold line breaks. A file of at most one task's bytes is
    read whole, a larger one in as many parts (`splitcsv`) with the same result.
    Files of one call must share their header and kind of line end.
    """
    paths = [path] if isinstance(path, str) else list(path)
    whole = spark.read.options(**CSV_READ).csv(paths)
    large = [r["path"] for r in listing(spark, paths).where(F.col("length") > range_bytes(spark)).collect()]  # one row per large file
    ends = {r["path"]: r["line_end"] for r in heads(spark, large).collect()} if large else {}
    large = [p for p in large if ends[p] != "\r"]  # files whose lines end in a return alone have but one line for Spark
    own = [file_path().alias(path_column)] if path_column else []
    if not large:
        return whole.select("*", *own)
    split = read_split(spark, large, whole.columns, ends[large[0]] == "\r\n", path_column)
    small = [r["path"] for r in listing(spark, paths).collect() if r["path"] not in set(large)]  # one row per file
    return spark.read.options(**CSV_READ).csv(small).select("*", *own).union(split) if small else split


def read_royalties(spark: SparkSession, path: str) -> DataFrame:
    """The stored royalty table; an empty one where nothing was stored yet."""
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def write_royalties(rows: DataFrame, path: str) -> None:
    """Store royalty rows under their dataset; a rerun replaces that dataset only.

    The rebalance hint lets the adaptive planner split a dataset that holds most
    rows over many tasks and merge small ones into few files.
    """
    (
        rows.hint("rebalance", F.col(DATASET_ID))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATASET_ID)
        .parquet(path)
    )


def clear_datasets(spark: SparkSession, path: str, datasets: list[str]) -> None:
    """Remove the stored rows of datasets that have none any more."""
    jvm = spark.sparkContext._jvm
    for dataset in datasets:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{DATASET_ID}={name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_csv(result: DataFrame, path: str) -> None:
    """Result rows as CSV: quotes only where needed, null as nothing."""
    result.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def json_rows(result: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON array in column order, nulls kept.

    Column names are the frame's own `columns`; the rows stay distributed.
    """
    cells = [
        F.regexp_replace(F.to_json(F.array(F.col(f"`{c}`"))), r"^\[|\]$", "")
        for c in result.columns
    ]
    return result.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias(name))


def json_objects(result: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON object, nulls kept."""
    return result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
