"""From raw documents to a sharded training mix, stage by stage.

Each stage is a function of (spark, docs, sf_dir) over all documents the stage
before kept; it returns the columns of `documents`, only the last one adds to
them. Columns beyond those an operator reads pass through untouched, whatever
their names. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import lang_id, mixing, sharding
from cadenza.llm.decontaminate import contamination
from cadenza.llm.near_dedup import near_duplicates
from cadenza.llm.ordering import ranked
from cadenza.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; the others stay as they are.

    That is a null text, one without a letter, or one that shares no n-gram with
    any learned profile. Where no row has a label, nothing is learned, and only
    texts without a letter go.
    """
    profiles = lang_id.learn(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_id.predicted(profiles, F.col("text"))
    return docs.where((found["lang"] != lang_id.UNKNOWN) & (found["score"] > 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    A document is an id with a text: rows of one id and different texts are
    different documents, and come after those whose id is theirs alone; rows
    without an id come last. Of rows that agree in id and text one stays.
    """
    keyed = _keyed(docs)
    texts = keyed.select(F.col("__key").alias("doc_id"), "text")
    kept = near_duplicates(texts).where("kept").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(_all(docs))


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a number per id and text: the id, or where it is missing or repeated one beyond all ids."""
    ids = staged(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    shared = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    own = docs.withColumn("__key", F.col("doc_id"))
    if shared.isEmpty():
        return own
    beyond = ids.agg(F.max("doc_id")).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    rest = docs.join(shared, same, "left_semi").withColumn("__hash", F.xxhash64("doc_id", "text"))
    rest = rest.withColumn("__none", F.col("doc_id").isNull())
    numbers = ranked(rest.select("__none", "doc_id", "__hash").distinct(), ["__none", "doc_id", "__hash"], "__key")
    numbers = numbers.select(F.col("__hash").alias("__h"), (F.col("__key") + beyond + 1).alias("__key"))
    rest = rest.join(numbers, F.col("__hash") == F.col("__h")).drop("__none", "__hash", "__h")
    return own.join(shared, same, "left_anti").unionByName(rest)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Rows are told apart by id and text together, so neither a null doc_id nor
    one with several texts takes a clean document along.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = F.xxhash64("doc_id", "text")
    texts = docs.select(own.alias("id"), "text")
    found = contamination(texts, benchmark, slop=0, id_column="id").where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.withColumn("__id", own).join(found, "__id", "left_anti").select(_all(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: not at all, once or twice."""
    rows = docs.select(*mixing.key_columns(), F.struct("*").alias("row"))
    taken = mixing.with_copies(rows, mixing.mixed_copies(docs))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").select("row", copies).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, law, shard and slot; columns of these names give way."""
    keys = sharding.key_columns()
    rows = docs.select(*keys, F.struct("*").alias("row"))
    placed = sharding.assign(rows, ["doc_id", "size", "text_crc32"], SHARDS)
    new = ["size", "text_crc32", "law", "shard", "slot"]
    old = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return placed.withColumn("law", F.lit("rows")).select(*old, *new)


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: None: profiles, drawn copies and the hash ring cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
