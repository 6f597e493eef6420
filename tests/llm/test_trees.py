"""Merkle manifest, token files and conversation trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import merkle, prefix_trie, token_files
from cadenza.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.cases import DOCS, lower, no_documents, odd_documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(str(value).encode())


# ---- manifest


def brute_manifest(rows):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def hashed(doc_id, source, lang, n_chars, text):
        return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))

    def climb(nodes):
        """Levels from the given digests up to one."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def beside(levels, at):
        for level in levels[:-1]:
            low = at // 16 * 16
            yield level[low:at], level[at + 1 : low + 16]
            at //= 16

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = hashed(doc_id, source, lang, n_chars, text)
        bent = doc_id is not None and crc(doc_id) % 5 == 0
        other = hashed(doc_id, source, lang, n_chars, None if text is None else lower(text)) if bent else own
        groups[source].append((doc_id is not None, doc_id, own, other))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([leaf for *_, leaf, _ in sorted(groups[s])]) for s in order]
    top = climb([t[-1][0] for t in trees])
    out = Counter()
    for place, source in enumerate(order):
        for at, (_, doc_id, leaf, fold) in enumerate(sorted(groups[source])):
            proof = ""
            for left, right in [*beside(trees[place], at), *beside(top, place)]:
                proof += "".join(left + right)
                fold = sha("".join(left) + fold + "".join(right))
            out[(doc_id, leaf, trees[place][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0])] += 1
    return out


def manifest_of(frame):
    return Counter(tuple(r) for r in merkle.manifest(frame).collect())


def plain(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_manifest_of_odd_rows(spark):
    frame = odd_documents(spark).selectExpr("*", "'x' as leaf", "2 as at", "3 as n", "4 as root", "5 as `group`")
    assert manifest_of(frame) == brute_manifest(plain(frame))
    assert merkle.manifest(no_documents(spark)).collect() == []


def test_manifest_of_uneven_sources(spark):
    """Sources of 1, 16, 17, 256, 257 and 700 rows, ids far apart, negative, repeated in masses and null."""
    rng, rows = random.Random(2), []
    for k, n in enumerate((1, 16, 17, 256, 257, 700)):
        for _ in range(n):
            doc_id = rng.choice([rng.randrange(-40, 40), rng.randrange(2**62), -rng.randrange(2**62), rng.randrange(70_000)])
            rows.append((doc_id, f"Text {rng.randrange(9)}", "en", f"s{k}", n))
    rows += [(5, "same", "en", "hot", 1)] * 300 + [(None, "same", None, "hot", i % 2) for i in range(40)] + [(i, "x", None, "hot", None) for i in range(60)]
    rows += [(i, "Y", None, f"many {i % 40}", 0) for i in range(100)] + [(1, "é", "fr", None, 1), (2, "z", "fr", "", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    assert manifest_of(frame) == brute_manifest(plain(frame))


# ---- token files


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def brute_tokens(rows, end_id=1):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = known.encode(text or "", add_special_tokens=False).ids + ([end_id] if end_id is not None else [])
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(frame, **how):
    return sorted((tuple(r) for r in token_files.round_trip(frame, tokenizer(), **{"end_id": 1} | how).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))


def test_token_files_of_the_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_tokens([(r.doc_id, r.text) for r in frame.collect()])
    assert read_back(frame) == want
    assert sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, SF).collect()) == want


@pytest.mark.parametrize("how", [{}, {"planes": "bit"}, {"planes": "bit", "width": 32}, {"width": 32, "end_id": None}])
def test_token_files_of_odd_rows(spark, how, monkeypatch):
    """Nulls, empty and very long texts, repeated rows and clashing names; small pieces, blocks and files."""
    monkeypatch.setattr(token_files, "PIECE", 5000)
    monkeypatch.setattr(token_files, "BLOCK", 700)
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    frame = odd_documents(spark).selectExpr("*", "1 as salt", "2 as tie", "3 as file", "'x' as value")
    told = read_back(frame, **how)
    want = brute_tokens([(r.doc_id, r.text) for r in frame.collect()], how.get("end_id", 1))
    key = lambda rows: Counter((d, n, c) for d, _, n, c in rows)
    assert key(told) == key(want)
    ends = 0
    for _, start, n, _ in sorted(told, key=lambda r: (r[1], r[2])):
        assert start == ends
        ends += n
    assert read_back(no_documents(spark), **how) == []


def test_spans_open_only_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 512)
    frame = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    path = token_files.write_files(frame.limit(60), tokenizer(), 1, str(tmp_path / "t"))
    index = token_files.chunk_index(spark, path).collect()
    data = {}
    for name in (tmp_path / "t").rglob("part-*"):
        reader = token_files.Reader(name.read_bytes())
        data[reader.task, reader.number] = reader
    assert sum(r.ids for r in index) == sum(int(x.n_tokens.sum()) for x in data.values())
    for reader in data.values():
        every = np.concatenate([reader.block(k) for k in range(len(reader.counts))])
        opened, block = [], reader.block
        reader.block = lambda k, opened=opened, block=block: opened.append(k) or block(k)
        for first, n in ((0, 1), (300, 500), (512, 512), (511, 2), (0, len(every)), (len(every) - 5, 5)):
            opened.clear()
            assert (reader.span(first, n) == every[first : first + n]).all()
            assert len(opened) <= -(-n // 512) + 1
    with pytest.raises(ValueError):
        token_files.Reader(b"x" * 100)


def test_words_read_by_parts_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, words = random.Random(1), token_files._words(tokenizer())
    whole = Tokenizer.from_file(tokenizer())
    some = ["the", "The", "don't", "it's", "a.b", "x. y", ".", "...", "word.", "é.", "naïve,", "İstanbul.", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>.",
            "3.5", " ", "a b", "ﬁn!", "é", "́x", "?!", "日本語。", "can't.", "end\n", "　", "\x1c", ""]
    texts = [rng.choice([" ", "\n", "", "  \t"]).join(rng.choice(some) for _ in range(rng.randrange(9))) for _ in range(2000)]
    ids, n = words.read(pa.array(texts))
    ends = np.cumsum(n)
    for text, low, high in zip(texts, ends - n, ends, strict=True):
        assert ids[low:high].tolist() == whole.encode(text, add_special_tokens=False).ids, text


# ---- trie


def brute_trie(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    every = {}
    for c, turns in own.items():
        h = crc(c) % 6
        lender = c - int(np.fmod(c, 100))
        every[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in every.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own_members in members.items():
        gain = (len(own_members) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += gain
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(every[c]) == len(k))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends))] += 1
    return out


CONVS = "conv_id long, turn long, role string, text string"


def trie_of(frame):
    return Counter(tuple(r) for r in prefix_trie.trie(frame).collect())


def test_trie_of_awkward_conversations(spark):
    """Long shared chains, a wide root, equal and missing turns, nulls, repeated rows, negative ids, no turns of their own left."""
    rng, rows = random.Random(6), []
    for c in range(60):  # one chain of 90 turns that conversations leave at different places
        rows += [(200 + c, t, "user", "same" if t < 90 - c else f"own {c} {t % 3}") for t in range(90)]
    rows += [(c, 0, None, f"first {c}") for c in range(-30, 60)]
    rows += [(c, rng.choice([None, 1, 1, 2]), rng.choice(["user", None, "bot"]), rng.choice(["a", "b", "", None])) for c in range(300, 340) for _ in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "x"), (777, None, None, None), (777, None, None, None), (2**62, 1, "user", "far")]
    frame = spark.createDataFrame(rows, CONVS)
    clash = frame.selectExpr("*", "1 as node", "2 as place", "'x' as depth", "3 as ends", "4 as part")
    assert trie_of(clash) == brute_trie(rows)
    assert prefix_trie.trie(frame.limit(0)).collect() == []
    assert prefix_trie.trie(frame.where("conv_id is null")).collect() == []


def test_trie_of_the_table(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_of(frame) == brute_trie([tuple(r) for r in frame.collect()])


def test_digests_of_large_groups_are_strings_in_order(spark, monkeypatch):
    """One node at which most conversations end, over many tasks and many strings a task."""
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 1, "user", "hello" if c % 5 else f"hello {c % 3}") for c in range(600)]
    frame = spark.createDataFrame(rows, CONVS).repartition(6)
    assert trie_of(frame) == brute_trie(rows)


def test_contraction_of_random_trees(spark):
    rng = random.Random(8)
    parent = {0: None}
    for v in range(1, 700):  # long chains, bushes and wide nodes
        parent[v] = v - 1 if rng.random() < 0.7 else rng.randrange(v)
    rows = [(v, p, rng.randrange(3), rng.randrange(100)) for v, p in parent.items()]
    want = {v: [a, b] for v, _, a, b in rows}
    for v, p, *_ in reversed(rows):
        if p is not None:
            want[p][0] += want[v][0]
            want[p][1] += want[v][1]
    tree = spark.createDataFrame(rows, "node long, parent long, leaves long, saved long")
    assert {r.node: [r.leaves, r.saved] for r in prefix_trie.contract(tree).collect()} == want
