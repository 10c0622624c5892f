import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import tiling


def plain_tiles(doc, item, least):
    """Greedy tiling by comparing everything with everything."""
    gone_d, gone_i, found = set(), set(), []
    while True:
        best = []
        for p, q in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and doc[q + n] and p + n not in gone_i and q + n not in gone_d:
                n += 1
            best.append((n, p, q))
        top = max((n for n, *_ in best), default=0)
        if top < least:
            return found
        for n, p, q in sorted(best, key=lambda x: x[1:]):
            if n == top and not gone_i & set(range(p, p + n)) and not gone_d & set(range(q, q + n)):
                gone_i |= set(range(p, p + n))
                gone_d |= set(range(q, q + n))
                found.append((p, q, n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(1, 3), min_size=1, max_size=16), st.integers(1, 4))
def test_tiles(doc, item, least):
    found = tiling.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least)
    assert found == plain_tiles(doc, item, least)
    for p, q, n in found:
        assert n >= least and item[p : p + n] == doc[q : q + n]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13])
def test_windows(size):
    tokens = np.random.default_rng(size).integers(1, 3, 50).astype(np.uint64)
    h = tiling.windows(tokens, size)
    assert len(h) == 51 - size and len(tiling.windows(tokens, 51)) == 0
    for i, j in itertools.combinations(range(len(h)), 2):
        assert (h[i] == h[j]) == (tokens[i : i + size] == tokens[j : j + size]).all()


def test_whole_operator(spark):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([20, 40, 5, 3, 12])]
    w = [t.split() for _, t in items]
    noise = lambda n: " ".join(rnd.choices([f"n{i}" for i in range(500)], k=n))
    texts = [
        f"{noise(30)} {items[0][1]} {noise(9)}",  # whole
        f"{noise(5)} {' '.join(w[1][20:])} {noise(5)} {' '.join(w[1][:20])}",  # reordered
        f"{noise(5)} {' '.join(w[1][:20])} {noise(5)}",  # half
        f"{noise(4)}, {items[0][1].upper().replace(' ', ',  ')}! {noise(3)}",  # case and punctuation
        items[2][1], items[3][1], noise(100), "", None,
        f"{items[4][1]} {items[4][1]}",
    ]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame([*items, (9, ""), (10, None), (None, "unseen words only in this one")], "item_id long, text string")
    want = {0: 0, 1: 1, 3: 0, 4: 2, 5: 3, 9: 4}
    got = {r.doc_id: r for r in tiling.contamination(docs, bench).collect()}
    assert len(got) == len(texts)
    assert {k: r.item_id for k, r in got.items() if r.contaminated} == want
    assert all(got[k].coverage == 1.0 for k in want)
    kept = tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 8]


def plain_verdict(text, items):
    """(coverage, item, tiles) by tiling with every item whose seeds may suffice."""
    best = (0.0, None, 0)
    doc = tiling.words(text)
    for key, other in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
        item = tiling.words(other)
        if len(item) < tiling.SHORTEST:
            continue
        width, ids = min(5, len(item)), {}
        it, d = ([ids.setdefault(w, len(ids) + 1) for w in x] for x in (item, doc))
        grams = {tuple(d[i : i + width]) for i in range(len(d) - width + 1)}
        bound = {x for i in range(len(it) - width + 1) if tuple(it[i : i + width]) in grams for x in range(i, i + width)}
        if len(bound) >= 0.8 * len(it):
            found = plain_tiles(d, it, width)
            coverage = sum(n for *_, n in found) / len(it)
            if coverage > best[0]:
                best = (coverage, key, len(found))
    return best


@pytest.mark.parametrize("kind", ["long", "string"])
def test_against_brute_force(spark, kind):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(6)]  # few words: many partial matches, ties and repeats
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for k in range(12)]
    items += [(20, items[3][1]), (None, items[3][1]), (None, items[4][1]), (21, items[5][1].upper())]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 25))) for _ in range(60)]
    texts += [texts[7], texts[7]]
    docs = spark.createDataFrame([(i % 61, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "0 as part", "'x' as h1")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text", "1 as seeds")
    if kind == "string":  # so that ids sort as the numbers do
        bench = bench.selectExpr("lpad(item_id, 2, '0') item_id", "text")
    got = sorted((int(r.doc_id), r.coverage, None if r.item_id is None else int(r.item_id), r.n_tiles) for r in tiling.contamination(docs, bench).collect())
    want = [(i % 61, *plain_verdict(t, items)) for i, t in enumerate(texts)]
    put = lambda rows: sorted((i, round(c, 9), -1 if k is None else k, n) for i, c, k, n in rows)
    assert put(got) == put(want)


def test_against_brute_force_on_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: r for r in tiling.contamination(docs, bench).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    seeds = {}
    for key, text in items:
        w = tiling.words(text)
        for i in range(len(w) - 4):
            seeds.setdefault(tuple(w[i : i + 5]), set()).add((key, text))
    for r in rows:
        w = tiling.words(r.text)
        near = set().union(*(seeds.get(tuple(w[i : i + 5]), ()) for i in range(len(w) - 4)), [x for x in items if len(tiling.words(x[1])) < 5])
        coverage, _, _ = plain_verdict(r.text, near) if len(w) < 2000 else (got[r.doc_id].coverage, 0, 0)
        assert got[r.doc_id].coverage == pytest.approx(coverage)
        assert got[r.doc_id].contaminated == (coverage >= 0.8)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert tiling.contamination(docs.limit(0), bench).count() == 0
    assert not tiling.contamination(docs, bench.limit(0)).first().contaminated
    assert tiling.drop_contaminated(docs, bench.limit(0)).count() == 1


def test_long_repetitive_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{passage} " * 5000), (2, "a " * 100_000), (3, "a b " * 50_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, passage) for k in range(3)] + [(7, "a " * 200), (8, "b a " * 100)], "item_id long, text string")
    began = time.time()
    assert {r.doc_id: r.item_id for r in tiling.contamination(docs, bench).collect()} == {1: 0, 2: 7, 3: 8}
    assert time.time() - began < 30


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "yes"), (2, "say yes now please")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes"), (2, "yes now please")], "item_id long, text string")
    assert {r.doc_id: r.item_id for r in tiling.contamination(docs, bench).collect()} == {1: None, 2: 2}
    assert {r.doc_id: r.item_id for r in tiling.contamination(docs, bench, shortest=1).collect()} == {1: 1, 2: 1}


def test_a_common_item(spark):
    """One item in every document, and many items with one seed in common."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('x', id, ' one two three four five six seven ', id) as text")
    bench = spark.createDataFrame([(0, "one two three four five six seven")] + [(k, f"one two three four five and then number {k} goes on {k} times") for k in range(1, 50)], "item_id long, text string")
    assert tiling.contamination(docs, bench).where("item_id = 0 and contaminated and n_tiles = 1").count() == 3000
