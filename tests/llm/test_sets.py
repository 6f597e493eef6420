"""Operators over whole tables: mixing, sharding, neighbours, order, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cadenza.llm import mixing, nearest, sharding
from cadenza.llm.ordering import ranked
from cadenza.session import staged
from tests.llm.cases import DOCS, SPACED, no_documents, odd_documents
from tests.llm.test_pairs import brute_components, brute_contamination
from tests.llm.test_rows import brute_languages


def brute_targets(sizes):
    """Targets of sources in order: the excess over the limit shared out again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest = 1.5 * sum(sizes.values())
    for _ in range(200):
        open_ = [s for s in order if target[s] < 2 * sizes[s]]
        if rest < 1e-9 or not open_:
            break
        share = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in open_:
            target[s] += share * weight[s]
            rest += max(0.0, target[s] - 2 * sizes[s])
            target[s] = min(target[s], 2 * sizes[s])
    return target


def test_mix_meets_targets(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in frame.select("doc_id", "source").collect()}
    rows = mixing.mix(frame).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)
    again = mixing.mix(frame.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_keeps_expectations(spark):
    """Over many seeds each document is taken about as often as its source's rate says."""
    units = spark.createDataFrame([(i, "s", 0.3, float(5 + i % 7)) for i in range(600)], "id long, source_key string, share double, words double")
    rows = mixing.rounded(units).collect()
    up = {r.id: r.up for r in rows}
    assert len(up) == 600 and abs(sum(up[i] * (5 + i % 7) for i in up) - 0.3 * sum(5 + i % 7 for i in up)) <= 12
    assert abs(sum(up.values()) - 180) < 60


def test_mix_of_odd_rows(spark):
    frame = odd_documents(spark)
    rows = mixing.mix(frame).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(SPACED.findall(r.text or ""))) for r in frame.collect())
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(no_documents(spark)).collect() == []


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min((counts[k] for k in range(shards)), default=0) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))


def test_shards_are_even_and_steady(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(frame).collect()
    check_shards(rows, 8)
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert all(place[r.doc_id] == (r.shard, r.slot) for r in sharding.shard_documents(frame.repartition(5)).collect())
    more = sharding.shard_documents(frame, 9).collect()
    check_shards(more, 9)
    moved = sum(place[r.doc_id][0] != r.shard for r in more) / len(more)
    assert moved < 0.3  # an even tenth goes to the new shard, some more where shards fill up


def test_shards_of_repeated_and_odd_rows(spark):
    same = spark.createDataFrame([(None, "x")] * 1000 + [(5, None)] * 500 + [(1, "")] * 3, "doc_id long, text string")
    check_shards(sharding.shard_documents(same).collect(), 8)
    rows = sharding.shard_documents(odd_documents(spark)).collect()
    check_shards(rows, 8)
    assert len(rows) == odd_documents(spark).count()
    assert sharding.shard_documents(no_documents(spark)).collect() == []


def test_a_ring_grows_with_its_shards():
    """Thousands of shards: every place has a cell of its own, and each shard all its places."""
    nodes = sharding.ring(3000)
    assert len(nodes) == 3000 * sharding.PLACES == len({cell for cell, _ in nodes})
    assert all(a < b for (a, _), (b, _) in zip(nodes, nodes[1:], strict=False)) and nodes[-1][0] < 1 << sharding.ring_bits(len(nodes))


def test_ring_fill_is_bounded_and_grows_in_place():
    before, after = dict(sharding.ring(8)), dict(sharding.ring(9))
    assert all(after[c] == s for c, s in before.items() if after[c] != 8)
    rnd = random.Random(1)
    owners = [s for _, s in sharding.ring(8)]
    counts = [rnd.randrange(40) for _ in owners]
    counts[3] = 9000
    bounds = sharding.bounds(sum(counts), 8, 0.05)
    pieces = sharding.fill(counts, owners, bounds)
    load = Counter()
    for p in pieces:
        load[p.shard] += p.count
    assert sum(load.values()) == sum(counts) and all(load[k] <= bounds[k] for k in range(8))


def test_ranks(spark):
    frame = spark.createDataFrame([(i * 7919 % 1000 // 3,) for i in range(1000)], "v long")
    rows = sorted((r.rank, r.v) for r in ranked(frame, ["v"]).collect())
    assert [r for r, _ in rows] == list(range(1000)) and [v for _, v in rows] == sorted(v for _, v in rows)


def brute_nearest(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in (i for i in ids if i % every == 0):
        score = x @ np.array(vectors[q], float)
        out[q] = [ids[j] for j in np.lexsort((np.array(ids), -score)) if ids[j] != q][:k]
    return out


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows):
        out[r.query_id].append(r.vec_id)
    return out


def test_nearest_recall(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_nearest({r.vec_id: r.embedding for r in frame.collect()}, 20, 20)
    rows = nearest.nearest(frame).collect()
    assert by_query(rows) == want
    vectors = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    assert max(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) for r in rows) < 1e-12
    # Windows much smaller than the table, so that blocks and curves are put to work.
    monkeypatch.setattr("cadenza.llm.nearest.WINDOW", 80)
    found = by_query(nearest.nearest(frame).collect())
    assert np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("kind", ["directions", "uneven", "clusters"])
def test_nearest_recall_with_windows_far_below_the_table(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    if kind == "clusters":
        x = rng.normal(size=(600, 32))[rng.integers(0, 600, 6000)] + 0.1 * x
    if kind == "uneven":
        x *= rng.lognormal(0, 1.5, size=(6000, 1))
    vectors = dict(enumerate(x.tolist()))
    monkeypatch.setattr("cadenza.llm.nearest.WINDOW", 20)
    monkeypatch.setattr("cadenza.llm.nearest.BLOCK_BYTES", 500 * 8 * 32)
    kept = []
    plan = nearest._window
    monkeypatch.setattr("cadenza.llm.nearest._window", lambda *a: kept.append(plan(*a)) or kept[-1])
    monkeypatch.setattr("cadenza.llm.nearest.ASKS", 100)
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found, want = by_query(nearest.nearest(frame).collect()), brute_nearest(vectors, 20, 20)
    recall = np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in want.items()])
    print(kind, "recall", recall, "window and curves", kept)
    if kind == "clusters":  # data with structure: a small part of the entries is looked at
        assert (2 * kept[0][0] + 1) * kept[0][1] < len(vectors) / 2
    assert recall >= 0.9


def test_nearest_of_odd_and_equal_vectors(spark):
    vectors = {i: [1.0, 2.0] if i % 2 else [float(i % 7), 1.0] for i in range(300)}
    odd = [(1000, None), (1001, [0.0, 0.0]), (1002, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1003, [None, 1.0]), (1004, [1.0]), (1005, []), (1006, [float("inf"), 1.0]), (4, [4.0, 1.0])]
    frame = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as rank")
    assert by_query(nearest.nearest(frame).collect()) == brute_nearest(vectors, 20, 20)
    assert nearest.nearest(frame.limit(0)).collect() == []


def test_hilbert_curve_visits_neighbours_in_turn():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = nearest.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pipeline_stages_against_loops(spark, sf):
    """Each stage on what the one before kept, held against the plain form of its operator."""
    extra = spark.createDataFrame([(5000, "123 456", None, "z", 7), (5001, None, None, None, None), (None, "the ofer anding", "en", "src1", 9)], DOCS)
    docs = staged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(extra))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = staged(stage(spark, docs, sf))
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        if name != "shard":
            assert out.columns == docs.columns
        if name == "language_id":
            und = {d for d, _, lang, score in brute_languages([(r.doc_id, r.text, r.lang) for r in rows]) if lang == "und" or score == 0}
            assert ids == Counter(r.doc_id for r in rows if r.doc_id not in und)
        elif name == "near_dedup":
            assert ids == Counter(d for d, _, _, kept in brute_components([(r.doc_id, r.text) for r in rows]) if kept)
        elif name == "decontamination":
            assert ids == Counter(k[0] for k in brute_contamination([(r.doc_id, r.text) for r in rows], items) if not k[5])
        elif name == "mix":
            assert ids == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
        else:
            assert ids == Counter(r.doc_id for r in rows)
            check_shards(got, corpus_pipeline.SHARDS)
        docs = out


def test_near_dedup_stage_keeps_every_text(spark, sf):
    """Rows that share an id, or have none, go only if their text is a copy."""
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(20)) for w in "abcd")
    rows = [(1, a), (1, b), (1, a), (None, a), (None, c), (None, c), (2, d), (3, d + " more"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.text or "", r.doc_id or -1) for r in got.collect()) == [("", -1), ("", 4), (a, 1), (b, 1), (c, -1), (d, 2)]


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf))
    assert docs.count() == 0


def test_pipeline_of_odd_rows(spark, sf):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf))
        assert name == "shard" or docs.columns == odd_documents(spark).columns
    assert "text" in docs.columns and docs.count() > 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
