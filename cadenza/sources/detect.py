"""Which distributor wrote a file: by its declared name or by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.files import SNIPPET_BYTES, heads

# The words that tell layouts apart in the order they are tried.
# A file with none of them is read as DistroKid.
MARKERS = (
    ("TuneCore", ("sales type", "total earned")),
    ("CDBaby", ("partner", "payable")),
    ("Symphonic", ("dsp", "net revenue")),
)
FALLBACK = "DistroKid"
DECLARED = {
    "distrokid": "DistroKid",
    "distro_kid": "DistroKid",
    "tunecore": "TuneCore",
    "tune_core": "TuneCore",
    "cdbaby": "CDBaby",
    "cd_baby": "CDBaby",
    "symphonic": "Symphonic",
}


def detect_source(content: Column) -> Column:
    """Layout of a file given its bytes.

    Only the snippet is looked at. If it ends inside a multi-byte character it
    is not valid text and counts as empty.
    """
    head = F.substring(content, 1, SNIPPET_BYTES).cast("string")
    snippet = F.when(F.is_valid_utf8(head), F.lower(head)).otherwise("")
    found = None
    for name, words in MARKERS:
        hit = F.lit(False)
        for word in words:
            hit = hit | snippet.contains(word)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise(FALLBACK)


def source_by_name(declared: Column) -> Column:
    """Layout of a declared name, spelled loosely; null if it is none of the four."""
    plain = F.lower(F.trim(declared))
    named = None
    for spelling, name in DECLARED.items():
        test = plain == spelling
        named = F.when(test, name) if named is None else named.when(test, name)
    return named


def source_of(declared: Column, content: Column) -> Column:
    """Declared layout if it is one, else the detected one."""
    return F.coalesce(source_by_name(declared), detect_source(content))


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and layout of every file below `path`, from its first bytes."""
    return heads(spark, path).select("path", "length", detect_source(F.col("snippet")).alias("source"))
