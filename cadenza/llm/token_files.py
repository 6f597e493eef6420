"""Token ids of documents in binary files of bit planes.

The ids of all documents, in ascending order of their ids, are cut into blocks
of 65,536. A block is transposed: plane k holds bit k (or byte k) of each id, so
the high planes, which hardly change, shrink to next to nothing. Each plane is
compressed with zstandard by itself. A file is

    the planes of block 0, the planes of block 1, ... , each block and a line end
    the index: magic, format, number of the file, then arrays of the blocks'
      offsets, ids and plane lengths, and of the documents' ids and lengths
    the offset of the index, the magic and a line end

all little-endian. The line ends are those of Spark's text writer, through which
blocks go as they are: what is committed is whole files, also when a task is lost
and runs again, on any file system Spark can write to. A reader finds any span of
ids from the index without touching other blocks.

Files hold about `FILE_IDS` ids; a document is in one file. Texts are dealt out
in order of doc_id by one range shuffle, and what a task gets it encodes, packs
and writes as a stream: ids are stored nowhere but in the files.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import buffers, cut, spaced
from cadenza.session import drop_at_exit, parallelism, shared_path, staged

BLOCK = 1 << 16
FILE_IDS = 1 << 24
MAGIC = b"CDZTOK1\n"
LEVEL = 3
#: Bytes of text that a task gets and that are encoded at a time; words whose ids a worker remembers, and that are read at once.
TASK_BYTES = 1 << 28
PIECE = 1 << 22
REMEMBERED = 400_000
AT_ONCE = 4096


# ---- text to ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


POINTS = ".,;:!?"
#: Every pair of ASCII letters side by side.
_PAIRS = "".join(a + b for a in ascii_letters for b in ascii_letters)


class _Words:
    """Ids of words as bytes of unsigned 32-bit numbers.

    The tokenizer must drop white space, so that each word is read by itself and
    none has to be read twice. Words go through the library's normalizer and
    splitter thousands at a time; each different piece goes through its model
    once. What was read last is remembered, up to a bound. Two shorter ways are
    taken only if the tokenizer itself shows that they are the same: that no two
    letters are ever split, and that a letter and a point always are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = self._split(_PAIRS) == [_PAIRS.lower()]
        glued = [a + b for a in ascii_letters for b in POINTS]
        self.points = all(self._split(g) == [g[0].lower(), g[1]] for g in glued) and not any(g in s for g in glued for s in self.special)

    def _split(self, text: str) -> list[str]:
        """The pieces of a text as the library's normalizer and splitter give them to the model."""
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)] if self.tokenizer.pre_tokenizer else []

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def ids(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        new = [k for k, own in enumerate(found) if own is None]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            for k, own in zip(some, self._read([words[k] for k in some]), strict=True):
                found[k] = own
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(zip(words, found, strict=True))
        else:
            self.known.update((words[k], found[k]) for k in new)
        return found

    def _alone(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _read(self, words: list[str]) -> list[bytes]:
        """Ids of new words: those of letters alone are one piece for the model, the others go through all steps."""
        if not self.letters:
            return self._read_all(words)
        whole = [w.isascii() and w.isalpha() for w in words]
        rest = [w for w, own in zip(words, whole, strict=True) if not own]
        others = iter(self._read_all(rest) if rest else [])
        return [self._piece(w.lower()) if own else next(others) for w, own in zip(words, whole, strict=True)]

    def _read_all(self, words: list[str]) -> list[bytes]:
        """Words with white space of their own or with a special token are left to the whole tokenizer."""
        text = " ".join(words)
        if len(text.split()) != len(words) or any(s in text for s in self.special):
            odd = {k for k, w in enumerate(words) if w.split() != [w] or any(s in w for s in self.special)}
            rest = iter(self._read_all([w for k, w in enumerate(words) if k not in odd]) if len(odd) < len(words) else [])
            return [self._alone(w) if k in odd else next(rest) for k, w in enumerate(words)]
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 0x20)
        if len(spaces) != len(words) - 1 or self.tokenizer.pre_tokenizer is None:
            return [self._alone(w) for w in words]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        known = self.pieces
        for piece, _ in split:
            if piece not in known:
                known[piece] = self._piece(piece)
        each = [known[piece] for piece, _ in split]
        starts = np.fromiter((place[0] for _, place in split), np.int64, len(split))
        bounds = np.searchsorted(np.searchsorted(spaces, starts), np.arange(len(words) + 1)).tolist()
        return [each[low] if high - low == 1 else b"".join(each[low:high]) for low, high in zip(bounds, bounds[1:], strict=False)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if self.points:  # a point after a word is a piece of its own, so the word is known with any point
            texts = pc.replace_substring_regex(texts, rf"([A-Za-z])([{POINTS}])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        each = self.ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        if not each:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, each), np.int32, len(each)) // 4
        which = words.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int64)
        skipped = (np.cumsum(sizes) - sizes)[which] - (ends - n)  # from a word's place in the texts to that in `each`
        ids = np.frombuffer(b"".join(each), np.uint32)[np.arange(ends[-1] if len(ends) else 0) + np.repeat(skipped, n)]
        so_far = np.concatenate(([0], ends))
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, so_far[at[1:]] - so_far[at[:-1]]


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    """One memory of words for all tasks of a Python worker."""
    return _Words(path)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Rows first to last of a column with their texts: of about PIECE bytes, or one long row in parts cut at white space."""
    data, starts = buffers(column)
    rows, row = len(starts) - 1, 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, "right")) - 1)
        own = data[starts[row] : starts[end]]
        if len(own) > PIECE:
            yield row, end, [pa.array([part.tobytes()], pa.binary()).cast(pa.string()) for part in cut(own, spaced)]
        else:
            offsets = pa.py_buffer((starts[row : end + 1] - starts[row]).astype(np.int32).tobytes())
            yield row, end, [pa.StringArray.from_buffers(end - row, offsets, pa.py_buffer(own.tobytes()))]
        row = end


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None, kind: np.dtype) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, ids a document has, and all ids in a row, for about PIECE bytes of texts at a time."""
    words = _words(tokenizer)
    for batch in batches:
        for first, last, parts in _pieces(batch.column(1)):
            read = [words.read(part) for part in parts]
            ids = np.concatenate([r[0] for r in read])
            n = read[0][1] if len(read) == 1 else np.array([sum(int(r[1].sum()) for r in read)])
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            yield batch.column(0).slice(first, last - first), n, ids.astype(kind)


# ---- planes


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Plane k holds bit k, or byte k, of every id of a block; plane 0 is the lowest."""
    octets = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if planes == "byte":
        return [octets[:, k].tobytes() for k in range(octets.shape[1])]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [plane.tobytes() for plane in packed]


def from_planes(planes: list[bytes], n: int, kind: np.dtype) -> np.ndarray:
    """The ids of a block of n."""
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == kind.itemsize:  # byte planes
        return np.ascontiguousarray(np.stack(rows, axis=1)).view(kind).reshape(n)
    bits = np.unpackbits(np.stack(rows), axis=1, bitorder="little")[:, :n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(kind).reshape(n)


# ---- files

_HEAD = struct.Struct("<8sHHIIQQ")  # magic, bits of an id, planes, task, file of the task, blocks, documents
_TAIL = struct.Struct("<Q8s")


class _File:
    """One file as it grows: whole blocks leave at once, the index last."""

    def __init__(self, kind: np.dtype, planes: str) -> None:
        self.kind, self.planes = kind, planes
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets: list[int] = []
        self.counts: list[int] = []
        self.lengths: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, missing: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_ids, missing, n))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.waiting)
            full = len(whole) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                yield self._block(whole[at : at + BLOCK])
            self.waiting, self.held = [whole[full:].copy()], len(whole) - full

    def _block(self, ids: np.ndarray) -> bytes:
        pressed = [self.press.compress(p) for p in to_planes(ids, self.planes)]
        self.offsets.append(self.at)
        self.counts.append(len(ids))
        self.lengths += [len(p) for p in pressed]
        self.at += sum(map(len, pressed)) + 1  # the line end
        return b"".join(pressed)

    def close(self, task: int, number: int) -> Iterator[bytes]:
        if self.held:
            yield self._block(np.concatenate(self.waiting))
        doc_ids, missing, n = (np.concatenate(column) for column in zip(*self.docs, strict=True))
        planes = self.kind.itemsize * (8 if self.planes == "bit" else 1)
        head = _HEAD.pack(MAGIC, 8 * self.kind.itemsize, planes, task, number, len(self.offsets), len(n))
        arrays = [(self.offsets, "<u8"), (self.counts, "<u4"), (self.lengths, "<u4"), (doc_ids, "<i8"), (missing, "u1"), (n, "<u8")]
        yield head + b"".join(np.asarray(a).astype(t).tobytes() for a, t in arrays) + _TAIL.pack(self.at, MAGIC)


def write_files(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None, width: int = 16, planes: str = "byte") -> str:
    """Encode every text and write the ids in ascending order of doc_id; returns the folder.

    Rows without a doc_id come first; rows that agree in doc_id follow each
    other in the order of a hash of their texts. `width` is 16 or 32 bits an id,
    `planes` is bit or byte.
    """
    spark = docs.sparkSession
    target = path or shared_path(spark, "tokens")
    kind = np.dtype(f"<u{width // 8}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parallelism(spark), -(-size // TASK_BYTES))
    order = ["doc_id", "tie", "salt"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, seq, file = 0, 0, _File(kind, planes)

        def out(values: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            places = pa.array(range(seq, seq + len(values)), pa.int64())
            seq += len(values)
            return pa.record_batch([pa.array([f"t{task:08d}-{number:06d}"] * len(values)), places, pa.array(values, pa.binary())], names=["file", "seq", "value"])

        for doc_ids, n, ids in _encoded(batches, tokenizer, end_id, kind):
            missing = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            doc_ids = doc_ids.fill_null(0).to_numpy()
            ends = np.cumsum(n)
            row = done = 0
            while row < len(n):
                # Up to and with the document that fills the file.
                stop = min(len(n), int(np.searchsorted(ends, done + FILE_IDS - file.ids)) + 1)
                values = list(file.add(ids[done : ends[stop - 1]], doc_ids[row:stop], missing[row:stop], n[row:stop]))
                done, row = int(ends[stop - 1]), stop
                if values:
                    yield out(values)
                if file.ids >= FILE_IDS:
                    yield out(list(file.close(task, number)))
                    number, file = number + 1, _File(kind, planes)
        if file.docs:
            yield out(list(file.close(task, number)))

    packed = dealt.mapInArrow(pack, "file string, seq long, value binary").sortWithinPartitions("file", "seq")
    packed.select("file", F.col("value").cast("string").alias("value")).write.partitionBy("file").text(target)
    if path is None:
        drop_at_exit(spark, target)
    return target


class Reader:
    """A file's index, and its ids by block or by span."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data = memoryview(data)
        begin, magic = _TAIL.unpack_from(self.data, len(self.data) - _TAIL.size - 1)
        if magic != MAGIC or begin + _HEAD.size > len(self.data):
            raise ValueError("not a file of token ids, or cut short")
        _, width, self.planes, self.task, self.number, blocks, docs = _HEAD.unpack_from(self.data, begin)
        self.kind = np.dtype(f"<u{width // 8}")
        at = begin + _HEAD.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(self.data, kind, n, at)
            at += found.nbytes
            return found

        self.offsets, self.counts = array("<u8", blocks), array("<u4", blocks)
        self.lengths = array("<u4", blocks * self.planes).reshape(blocks, self.planes)
        self.doc_ids, self.missing, self.n_tokens = array("<i8", docs), array("u1", docs), array("<u8", docs)
        self._open = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, planes = int(self.offsets[k]), []
        for length in self.lengths[k].tolist():
            planes.append(self._open.decompress(self.data[at : at + length]))
            at += length
        return from_planes(planes, int(self.counts[k]), self.kind)

    def span(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n of the file; only the blocks that hold them are opened."""
        ends = np.cumsum(self.counts)
        low, high = np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + n)
        found = np.concatenate([self.block(k) for k in range(low, min(high + 1, len(ends)))] or [np.zeros(0, self.kind)])
        begin = first - (int(ends[low - 1]) if low else 0)
        return found[begin : begin + n]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files under `path`.

    Blocks are opened one at a time. `start` counts the ids of all documents
    before, in this and earlier files; `ids_crc32` is that of the ids as unsigned
    32-bit numbers.
    """
    names = ["task", "file", "doc_id", "inner", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = Reader(content.as_buffer())
                n = reader.n_tokens.astype(np.int64)
                ids = pa.array(reader.doc_ids, pa.int64(), mask=reader.missing.astype(bool))
                sums = pa.array(_checksums(reader, n), pa.int64())
                place = [pa.array(np.full(len(n), v, np.int64)) for v in (reader.task, reader.number)]
                yield pa.record_batch([*place, ids, pa.array(np.cumsum(n) - n), pa.array(n), sums], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = staged(files.mapInArrow(run, ", ".join(f"{name} long" for name in names)))
    sizes = found.groupBy("task", "file").agg(F.sum("n_tokens").alias("ids"))  # one row per file
    earlier = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("task", "file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    start = (F.col("inner") + F.col("before")).alias("start")
    return found.join(before, ["task", "file"]).select("doc_id", start, "n_tokens", "ids_crc32")


def _checksums(reader: Reader, n: np.ndarray) -> list[int]:
    """crc32 of each document's ids, block by block."""
    sums, left, doc, sofar = [], n.tolist(), 0, 0
    while doc < len(left) and left[doc] == 0:
        sums.append(0)
        doc += 1
    for k in range(len(reader.counts)):
        octets = memoryview(reader.block(k).astype("<u4").tobytes())
        at = 0
        while at < len(octets):
            take = min(len(octets) - at, 4 * left[doc])
            sofar = zlib.crc32(octets[at : at + take], sofar)
            at += take
            left[doc] -= take // 4
            while doc < len(left) and left[doc] == 0:
                sums.append(sofar)
                doc, sofar = doc + 1, 0
    return sums


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """task, file, block, offset, bytes, first and ids of every block: where each span of ids lies."""
    names = ["task", "file", "block", "offset", "bytes", "first", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                r = Reader(content.as_buffer())
                counts = r.counts.astype(np.int64)
                k = len(counts)
                columns = [np.full(k, r.task), np.full(k, r.number), np.arange(k), r.offsets, r.lengths.sum(axis=1), np.cumsum(counts) - counts, counts]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None, width: int = 16, planes: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files that were written.

    A null or empty text has the end id alone, or nothing. Texts of any length
    are encoded whole, in parts of a few megabytes cut at white space. Rows that
    repeat are documents of their own; other columns have no part. An empty
    table gives no files and no rows. Strings of special tokens in a text are
    read as the tokenizer's file has them.
    """
    target = write_files(docs, tokenizer, end_id, path, width, planes)
    spark = docs.sparkSession
    if not _files(spark, target):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, target)


def _files(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return any(not f.getPath().getName().startswith(("_", ".")) for f in found)
