"""Small tables that every operator must stand."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"w{i % 977} and{i % 13}" for i in range(60_000))


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " now", None, "b", None),
        (4, None, "en", None, 0),
        (5, "", None, "b", 0),
        (6, " \n\t", "en", "b", 3),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (7, LONG, "en", "a", len(LONG)),
        (8, LONG + " more", "en", "c", len(LONG)),
        (9, "MIT License", "en", "c", 11),
        (10, "12345 67890", None, "c", 11),
        (11, "der Fuchs springt über den faulen Hund und läuft weit weg von hier", "de", "c", 60),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr("*", "1 as node", "'x' as key", "2 as rank", "3 as size", "4 as shard", "5 as score")


def no_documents(spark):
    return odd_documents(spark).limit(0)
