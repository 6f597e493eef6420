"""Tables cut into hash buckets, of which a change writes only those it touches.

A manifest names the folder of every bucket of every table. A change writes new
folders beside the old ones and then puts the next manifest, which must not be
there yet: of two changes made from one manifest the second is refused and is
made again from the newer one. Readers see whole manifests only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Seconds after which a manifest that is not whole counts as left behind by a broken writer.
PATIENCE = 30
_END = "whole"


@dataclass(frozen=True)
class Manifest:
    """A state of all tables: folder by bucket by table, and the runs that led to it."""

    version: int = 0
    runs: tuple[str, ...] = ()
    tables: Mapping[str, Mapping[int, str]] = field(default_factory=dict)

    def with_change(self, run: str, written: Mapping[str, Mapping[int, str]], version: int) -> Manifest:
        tables = {name: {**self.tables.get(name, {}), **written.get(name, {})} for name in {*self.tables, *written}}
        return Manifest(version, (*self.runs, run), tables)


class Conflict(Exception):
    """Another change came first."""


def bucket_of(keys: Iterable[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


class Store:
    """The tables below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def _read(self, version: int) -> Manifest | None:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        if not text.endswith(_END):
            return None
        held = json.loads(text.removesuffix(_END))
        tables = {name: {int(k): v for k, v in own.items()} for name, own in held["tables"].items()}
        return Manifest(version, tuple(held["runs"]), tables)

    def newest(self, version: int | None = None) -> tuple[Manifest, int]:
        """The newest whole manifest (or that of a version), and the number the next one takes."""
        versions = self._versions()
        waited = 0.0
        for own in reversed(versions if version is None else [v for v in versions if v <= version]):
            while (found := self._read(own)) is None and waited < PATIENCE:
                time.sleep(0.5)  # its writer may be at work
                waited += 0.5
            if found is not None:
                return found, versions[-1] + 1
        return Manifest(), (versions[-1] if versions else 0) + 1

    def commit(self, manifest: Manifest) -> None:
        """Put a manifest; Conflict if its number is taken."""
        target = self._path(f"{self.root}/manifests/{manifest.version:012d}.json")
        text = json.dumps({"runs": manifest.runs, "tables": manifest.tables}) + _END
        try:
            stream = self._fs.create(target, False)
        except Exception as error:
            if self._fs.exists(target):
                raise Conflict(str(target)) from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def table(self, manifest: Manifest, name: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets, as a manifest has them."""
        known = manifest.tables.get(name, {})
        folders = sorted({known[b] for b in (known if buckets is None else buckets) if known.get(b)})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{name}/{f}" for f in folders])

    def write(self, name: str, old: DataFrame, new: DataFrame, keys: list[Column]) -> dict[int, str]:
        """Write the buckets in which the two differ; returns their folders."""
        own = bucket_of(keys).alias("bucket")
        differ = new.exceptAll(old).select(own).union(old.exceptAll(new).select(own)).distinct()
        changed = [r["bucket"] for r in differ.collect()]  # at most BUCKETS
        if not changed:
            return {}
        folder = uuid.uuid4().hex
        rows = new.withColumn("bucket", own).where(F.col("bucket").isin(changed)).repartition("bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/data/{name}/{folder}")
        there = {b for b in changed if self._fs.exists(self._path(f"{self.root}/data/{name}/{folder}/bucket={b}"))}
        return {b: f"{folder}/bucket={b}" if b in there else "" for b in changed}  # no folder: no rows are left

    def change(self, run: str, make: Callable[[Manifest], Mapping[str, Mapping[int, str]]]) -> None:
        """Apply a change under a run's name, again from the newest state as long as others come first.

        `make` writes buckets from a manifest and tells their folders. A run
        that is in the manifest has been applied and is not applied again.
        """
        while True:
            base, version = self.newest()
            if run in base.runs:
                return
            try:
                self.commit(base.with_change(run, make(base), version))
                return
            except Conflict:
                continue


def touched(rows: DataFrame, keys: list[Column]) -> list[int]:
    """Buckets that rows fall into."""
    return [r["bucket"] for r in rows.select(bucket_of(keys).alias("bucket")).distinct().collect()]  # at most BUCKETS
