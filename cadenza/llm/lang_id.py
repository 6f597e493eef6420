"""Language identification by rank-order n-gram profiles and out-of-place distance.

Letters are lower-cased one by one, everything else parts words, and a word with
a mark at either end gives its n-grams of one to three letters. A language's
profile is the ranking of its most frequent n-grams over all training texts; a
text's is that of its own. The distance adds up how far each of the text's
n-grams is from its place in the language's profile, `PROFILE` where it has none.

Counting needs no table of words: three code points of 21 bits are one exact
63-bit number, and a piece of text is counted by sorting such numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import PIECE, buffers, cut, spaced

GRAM = 3
PROFILE = 400
#: Bound on what is kept of the profiles: a table with more labels is not labelled by language.
MAX_LANGUAGES = 4096
UNKNOWN = "und"

_MARK = 1  # stands at both ends of a word
_fold = np.full(0x110000, -1, np.int32)


def _folded(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters; the mark for all else."""
    out = _fold[points]
    if (new := points[out < 0]).size:
        for c in np.unique(new).tolist():
            _fold[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else _MARK
        out = _fold[points]
    return out


def _counted(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count, ordered by row and n-gram, of the rows that begin at `starts`."""
    text = data.tobytes().decode("utf-8", "replace")
    points = _folded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = lead[starts]
    # A mark before each row and one at the end.
    seq = np.insert(points, begin, _MARK)
    seq = np.append(seq, _MARK)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(begin, len(points))) + 1)
    row = np.append(row, max(len(starts) - 1, 0))
    used = np.zeros(0x110000, bool)
    used[seq] = True
    used[_MARK] = True
    letters = np.flatnonzero(used)  # the mark comes first
    small = np.zeros(0x110000, np.int64)
    small[letters] = np.arange(1, len(letters) + 1)
    s = small[seq]
    base = len(letters) + 1
    if len(starts) * base**GRAM >= 1 << 62:
        half = len(starts) // 2
        if not half:
            raise ValueError("a text with more different letters than Unicode has")
        left = _counted(data[: starts[half]], starts[:half])
        right = _counted(data[starts[half] :], starts[half:] - starts[half])
        return tuple(np.concatenate(x) for x in zip(left, (right[0] + half, *right[1:]), strict=True))
    letter = s != 1
    one = row * base**GRAM + s
    two = row[:-1] * base**GRAM + s[:-1] * base + s[1:]
    three = row[:-2] * base**GRAM + (s[:-2] * base + s[1:-1]) * base + s[2:]
    keys = np.concatenate((one[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]))
    # An n-gram of two belongs to the row of its letter: a mark before a row is the row's own.
    if len(starts) * base**GRAM < 1 << 32:
        keys = keys.astype(np.uint32)
    keys = np.sort(keys).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(keys)))
    rows, code = np.divmod(keys[head], base**GRAM)
    real = np.concatenate(([0], letters))
    exact = (real[code // (base * base)] << 42) | (real[code // base % base] << 21) | real[code % base]
    return rows, exact, counts


def gram_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and number of rows of a piece; the row within it, n-gram and count of each entry."""
    data, starts = buffers(column)
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, "right")) - 1)
        own = data[starts[row] : starts[end]]
        if len(own) > PIECE:
            parts = [_counted(x, np.zeros(1, np.int64)) for x in cut(own, spaced)]
            codes, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[2] for p in parts])).astype(np.int64)
            yield row, 1, np.zeros(len(codes), np.int64), codes, counts
        else:
            yield row, end - row, *_counted(own, starts[row:end] - starts[row])
        row = end


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        label = langs.indices.to_numpy()
        kept: list[tuple[np.ndarray, ...]] = []
        for row, _, rows, codes, counts in gram_counts(batch.column(1)):
            own = label[row + rows]
            for k in np.unique(own):
                at = own == k
                gram, where = np.unique(codes[at], return_inverse=True)
                kept.append((np.full(len(gram), k), gram, np.bincount(where, counts[at]).astype(np.int64)))
        if not kept:
            continue
        which, gram, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((gram, which))
        which, gram, n = which[order], gram[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (which[1:] != which[:-1]))))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(which[head])), pa.array(gram[head]), pa.array(np.add.reduceat(n, head))],
            ["lang", "gram", "n"],
        )


class Profiles:
    """The rank of every profiled n-gram in every language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), PROFILE, np.int32)
        place = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest language, -1 for a row without letters, and its closeness."""
        best, close = np.full(len(column), -1), np.zeros(len(column))
        if not self.langs:
            return best, close
        for first, _, rows, codes, counts in gram_counts(column):
            if not len(rows):
                continue
            rows, codes = _top(rows, codes, counts)
            head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            size = np.diff(np.append(head, len(rows)))
            rank = np.arange(len(rows)) - np.repeat(head, size)
            at = np.searchsorted(self.grams, codes)
            at[at == len(self.grams)] = 0
            at = np.where(self.grams[at] == codes, at, len(self.grams))
            there = self.ranks[at]
            apart = np.where(there == PROFILE, PROFILE, np.abs(there - rank[:, None].astype(np.int32)))
            total = np.add.reduceat(apart, head, axis=0, dtype=np.int64)
            own = first + rows[head]
            best[own] = total.argmin(axis=1)
            close[own] = 1 - total.min(axis=1) / (size * PROFILE)
        return best, close


def _top(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's most frequent n-grams, the most frequent first, ties by n-gram."""
    most = int(counts.max())
    at, up = len(rows).bit_length(), most.bit_length()
    if int(rows[-1]).bit_length() + up + at <= 63:
        order = np.sort((rows << (up + at)) | ((most - counts) << at) | np.arange(len(rows))) & ((1 << at) - 1)
    else:
        order = np.lexsort((codes, -counts, rows))
    rows = rows[order]
    head = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - head < PROFILE
    return rows[keep], codes[order][keep]


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; a row without an id is in neither fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Profiles:
    """Profiles from the labelled rows outside the held-out fold, counted over all of them.

    At most MAX_LANGUAGES times PROFILE rows come to the driver; more labels are an error.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.select("lang", "text").mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    found = top.select("lang", "gram", "rank").limit(MAX_LANGUAGES * PROFILE + 1).collect()
    if len(found) > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles([tuple(r) for r in found])


def predicted(profiles: Profiles, text: Column) -> Column:
    """struct<lang, score> of a text column, for all languages the profiles hold.

    A null text, an empty one, or one without a letter is UNKNOWN with score 0;
    all texts are where nothing was learned. The score is one less the mean
    distance over the largest one. Equal distances go to the first language in
    code-point order.
    """

    @F.arrow_udf("struct<lang string, score double>")
    def identify(texts: pa.Array) -> pa.Array:
        best, close = profiles.predict(texts)
        names = pa.array([*profiles.langs, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(best % len(names))), pa.array(close)], ["lang", "score"])

    return identify(text)


def identify_languages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Rows with a null doc_id or lang are predicted but not learned from; repeated
    rows each count. An empty table gives an empty result.
    """
    profiles = learn(documents, id_column, text_column, lang_column)
    found = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(profiles, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
