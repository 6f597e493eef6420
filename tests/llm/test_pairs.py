"""Near duplicates and decontamination against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from cadenza.llm.decontaminate import WINDOW, contamination, matches
from cadenza.llm.graph import components
from cadenza.llm.near_dedup import near_duplicates
from tests.llm.cases import ALNUM, SPACED, lower, no_documents, odd_documents


def brute_components(rows):
    """Per (doc_id, text) row: set size and smallest doc_id reachable."""
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = Counter()
    for (d, _), s in zip(rows, sets, strict=True):
        c = None if d is None else find(d)
        out[(d, len(s), c, d is None or c == d)] += 1
    return out


def found(frame):
    return Counter(tuple(r)[:4] for r in near_duplicates(frame).collect())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 60))


def test_near_duplicates_of_odd_rows(spark):
    frame = odd_documents(spark)
    assert found(frame) == brute_components([(r.doc_id, r.text) for r in frame.collect()])
    assert near_duplicates(no_documents(spark)).collect() == []


def test_near_copies_at_all_distances(spark):
    """Edits of one text, dense around the threshold, chain up exactly as in all pairs."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(160):
        own = list(words)
        for at in rnd.sample(range(60), rnd.randrange(0, 9)):
            own[at] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(5, " ".join(f"y{k}" for k in range(30))), (900, " ".join(f"y{k}" for k in range(30)))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_near_duplicates_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark.read.parquet(f"{sf}/documents.parquet")) == brute_components(rows)


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        if w:
            for i in range(max(1, len(w) - WINDOW + 1)):
                windows[tuple(w[i : i + WINDOW])].update([] if item is None else [str(item)])
    out = Counter()
    for d, text in rows:
        w = ALNUM.findall(lower(text))
        hit, of = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    of |= own
                    hit.update(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        out[(d, len(w), len(hit), len(of), digest, bool(hit))] += 1
    return out


@pytest.mark.parametrize("rounds", [1, 3])
def test_contamination_on_the_table_and_odd_rows(spark, sf, rounds, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    own = [(900, "quick brown FOX"), (901, None), (902, "--"), (None, "lazy dog"), (903, "w1 and1 w2 and2 w3 and3 w4 and4 w5 and5 w6"), (903, "dog")]
    items = items.union(spark.createDataFrame(own, "item_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    if rounds > 1:  # a benchmark too large for one round is taken in several
        monkeypatch.setattr("cadenza.llm.decontaminate.ROUND", 400)
    got = Counter(tuple(r)[:6] for r in contamination(docs, items).collect())
    assert got == brute_contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_no_documents_and_no_items(spark, sf):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_documents(spark), items).collect() == []
    assert all(not r.contaminated for r in contamination(odd_documents(spark), items).collect())


def test_an_item_without_an_id_still_hits(spark):
    docs = odd_documents(spark).selectExpr("*", "1 as item", "2 as window", "3 as term", "4 as n_hit")
    items = spark.createDataFrame([(None, "lazy dog and runs"), (None, "lazy dog and runs")], "item_id long, text string")
    found = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert (found[1].n_hit, found[1].n_items, found[1].contaminated, found[9].contaminated) == (4, 0, True, False)


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = "intro alpha beta gamma well delta epsilon zeta eta theta iota kappa end"
    far = "alpha beta gamma one two three four delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, item), (2, near), (3, far)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    _, hits = matches(docs, items)
    assert {(r.doc, r.kind) for r in hits.collect()} == {(1, "phrase"), (2, "proximity")}
