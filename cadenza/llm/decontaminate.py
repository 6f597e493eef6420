"""Benchmark passages in training texts, through a positional inverted index.

The benchmark's windows of consecutive words are the phrases to find. One pass
over the texts counts the windows' terms in the whole corpus; that ranks each
window's terms from its rarest. A second pass stores the index: postings (text,
term, position) of test terms, kept only where the postings of a window's two
rarest terms, each moved back by its offset in the window, meet in a text within
the slop. Every match has these two, so nothing that can match is left out, and
common words are stored around them only.

Matching is then joins: the rarest term's postings propose starts, and a start
is a match if the offset-adjusted postings of all the window's other terms are
there too: at their exact places for a phrase, within `slop` for proximity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import alnum, lists, mixed, signed, words
from cadenza.session import staged

WINDOW = 10
#: Words a text's term may be away from its place and still count as near.
SLOP = 2
#: Windows whose terms go to every task at once (about 20 MB); a larger benchmark is taken in several rounds.
ROUND = 1 << 18

_NULL = np.uint64(0xA5A5F00D5EEDC0DE)
_ODD = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, keys, sizes, terms = [], [], [], []
        for part in words(batch.column(1), alnum):
            at = 0
            for row, count in enumerate(part.counts.tolist(), part.row):
                size = min(count, WINDOW)
                for start in range(at, at + count - size + 1) if count else ():
                    own = part.hashes[start : start + size]
                    which.append(row)
                    keys.append(mixed((own * _ODD[:size]).sum(keepdims=True) + _NULL * np.array([size], np.uint64)))
                    sizes.append(size)
                    terms.append(own)
                at += count
        flat = signed(np.concatenate(terms)) if terms else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(which, pa.int64())), pa.array(signed(np.concatenate(keys)) if keys else [], pa.int64()), lists(sizes, flat, pa.int64())],
            ["item", "window", "terms"],
        )


class _Vocabulary:
    """Which words are test terms: a bitmap first, then a search among the sorted terms."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms.view(np.uint64))
        self.mask = np.uint64((1 << max(16, int(len(self.terms)).bit_length() + 6)) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.terms & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of test terms among the words, and which terms they are."""
        at = np.flatnonzero(self.seen[hashes & self.mask])
        if not len(self.terms):
            return at[:0], at[:0]
        term = np.searchsorted(self.terms, hashes[at])
        term[term == len(self.terms)] = 0
        same = self.terms[term] == hashes[at]
        return at[same], term[same]


def _counter(vocabulary: _Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.terms), np.int64)
        for batch in batches:
            for part in words(batch.column(0), alnum):
                total += np.bincount(vocabulary.find(part.hashes)[1], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(signed(vocabulary.terms[there])), pa.array(total[there])], ["term", "n"])

    return count


class _Rarest:
    """Of every window its length and its two rarest terms with their offsets, ordered by the rarest."""

    def __init__(self, rows: list):
        columns = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 5)
        columns = columns[np.argsort(columns[:, 0].view(np.uint64), kind="stable")]
        self.size, self.offset, self.offset2 = columns[:, 1], columns[:, 2], columns[:, 4]
        self.second = columns[:, 3].copy().view(np.uint64)
        first = columns[:, 0].copy().view(np.uint64)
        self.vocabulary = _Vocabulary(first)
        self.begin = np.searchsorted(first, self.vocabulary.terms)
        self.count = np.diff(np.append(self.begin, len(first)))

    def spans(self, hashes: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, slop: int) -> np.ndarray:
        """Which words lie where the two rarest terms of some window meet."""
        at, term = self.vocabulary.find(hashes)
        repeat = self.count[term]
        at = np.repeat(at, repeat)
        which = np.repeat(self.begin[term], repeat) + np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        start = at - self.offset[which]
        end = start + self.size[which]
        low, high = row_start[at], row_end[at]
        near = (start >= low - slop) & (end <= high + slop)
        start, end, low, high, which = (x[near] for x in (start, end, low, high, which))
        meets = np.zeros(len(start), bool)
        for shift in range(-slop, slop + 1):
            place = start + self.offset2[which] + shift
            inside = (place >= low) & (place < high)
            meets |= inside & (hashes[np.where(inside, place, 0)] == self.second[which])
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(start[meets] - slop, low[meets]), 1)
        np.add.at(edge, np.minimum(end[meets] + slop, high[meets]), -1)
        return np.cumsum(edge[:-1]) > 0


def _indexer(vocabulary: _Vocabulary, rarest: _Rarest, slop: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            for part in words(batch.column(1), alnum):
                counts, hashes = part.counts, part.hashes
                begin = np.cumsum(counts) - counts
                place = np.arange(len(hashes)) - np.repeat(begin, counts)
                mark = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ mixed(place)), dtype=np.uint64)))
                key = mark[begin + counts] - mark[begin]
                key ^= null[part.row : part.row + len(counts)] * _NULL
                inside = rarest.spans(hashes, np.repeat(begin, counts), np.repeat(begin + counts, counts), slop)
                at = np.flatnonzero(inside)
                at = at[vocabulary.find(hashes[at])[0]]
                held = np.diff(np.searchsorted(at, np.append(begin, len(hashes))))
                own = ids.slice(part.row, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(signed(key)), pa.array(counts, pa.int64()), lists(held, signed(hashes[at]), pa.int64()), lists(held, place[at], pa.int64())],
                    ["doc_id", "key", "n_words", "terms", "positions"],
                )

    return index


_INDEX = "doc_id long, key long, n_words long, terms array<long>, positions array<long>"
_TEXT = ["doc", "key"]


def _round(texts: DataFrame, windows: DataFrame, slop: int) -> tuple[DataFrame, DataFrame]:
    """The index for one round of windows, and the matches in it."""
    listed = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    known = np.array([r[0] for r in windows.select(F.explode("terms")).distinct().collect()], np.int64)
    vocabulary = _Vocabulary(known)
    counts = texts.select("text").mapInArrow(_counter(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("n", "term", "offset"))
    ranked = listed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", rank)
    terms = staged(ranked.select("window", "size", "offset", "term", "rank"))
    first = terms.where("rank = 1")
    second = terms.where("rank = least(2, size)").select("window", F.col("term").alias("term2"), F.col("offset").alias("offset2"))
    pairs = first.join(second, "window").select("term", "size", "offset", "term2", "offset2")
    rarest = _Rarest(pairs.collect())  # at most ROUND rows
    index = staged(texts.mapInArrow(_indexer(vocabulary, rarest, slop), _INDEX))

    once = index.where(F.size("terms") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "key", "terms", "positions").dropDuplicates(_TEXT)
    postings = once.select(*_TEXT, F.explode(F.arrays_zip("terms", "positions")).alias("p"))
    postings = staged(postings.select(*_TEXT, F.col("p.terms").alias("term"), F.col("p.positions").alias("position")))
    start = (F.col("position") - F.col("offset")).alias("start")
    starts = postings.join(first, "term").select(*_TEXT, "window", "size", start)
    wanted = starts.join(terms.select("window", "offset", "term"), "window")

    def met(of: DataFrame, slop: int) -> DataFrame:
        shifts = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])
        places = of.select("*", F.explode(shifts).alias("shift")).withColumn("position", F.col("start") + F.col("offset") + F.col("shift"))
        found = places.join(postings, [*_TEXT, "term", "position"]).groupBy(*_TEXT, "window", "size", "start")
        found = found.agg(F.count_distinct("offset").alias("found"), F.min("position").alias("first"), F.max("position").alias("last"))
        return found.where("found = size").select(*_TEXT, "window", "first", "last", "start")

    exact = staged(met(wanted, 0).withColumn("kind", F.lit("phrase")))
    if not slop:
        return index, exact
    rest = wanted.join(exact, [*_TEXT, "window", "start"], "left_anti")
    return index, exact.unionByName(met(rest, slop).withColumn("kind", F.lit("proximity")))


def matches(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, key, n_words) and the matches in them.

    A match has doc and key of its text, the item, the words `first` to `last`
    of the text, and kind `phrase` or `proximity`. Rows that agree in doc_id and
    words have one key and share their matches. Texts and items that are null or
    without words have none. What an item without an id matches is a match like
    any other, with a null item. Other columns have no part, whatever their
    names; texts of any length are indexed whole, in pieces.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    windows = staged(items.mapInArrow(_windows, "item string, window long, terms array<long>"))
    distinct = staged(windows.select("window", "terms").dropDuplicates(["window"]))
    rounds = max(1, -(-distinct.count() // ROUND))
    parts = [_round(texts, distinct.where(F.pmod("window", F.lit(rounds)) == k), slop) for k in range(rounds)]
    of_item = windows.select("item", "window").distinct()
    found = reduce(DataFrame.unionByName, [m for _, m in parts]).join(of_item, "window")
    return parts[0][0].select("doc_id", "key", "n_words"), found


def contamination(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP, **columns: str) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; all of phrases, plus n_near.

    n_hit counts the words inside a phrase match, each once; n_near the items
    found in proximity only. Items without an id hit words but are not listed. See `matches` for nulls, empty and repeated rows.
    """
    texts, found = matches(documents, benchmark, slop, **columns)
    found = staged(found)
    phrases = found.where("kind = 'phrase'")
    spans = phrases.select(*_TEXT, "first", "last").distinct()
    before = Window.partitionBy(*_TEXT).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    hits = spans.withColumn("fresh", fresh).groupBy(*_TEXT).agg(F.sum("fresh").alias("n_hit"))
    items = phrases.select(*_TEXT, "item").distinct().groupBy(*_TEXT).agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = found.select(*_TEXT, "item", (F.col("kind") == "phrase").cast("int").alias("exact")).groupBy(*_TEXT, "item").agg(F.max("exact").alias("exact"))
    near = near.where("exact = 0").groupBy(*_TEXT).agg(F.count("item").alias("n_near"))
    by_text = hits.join(items, _TEXT, "full").join(near, _TEXT, "full")
    rows = texts.withColumn("doc", F.coalesce("doc_id", F.lit(0))).join(by_text, _TEXT, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
