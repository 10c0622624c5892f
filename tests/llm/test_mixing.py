import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bramble.llm import mixing
from bramble.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes):
    """The rule as it reads: share out, cut, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        heavy = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / heavy
        left = 0.0
        for s in sorted(open_, key=str):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "en", rnd.choice(["a", "a", "a", "b", "c", "é", "Z", None]), 0) for i in range(600)]
    rows += [(3, None, "en", "a", 0), (3, "x  y\x0b z ", "en", "a", 0), (3, "x  y\x0b z ", "en", "a", 0), (None, "one two", "en", "b", 0), (900, "", "en", "only empty", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mixture(docs):
    got = mixing.mixture(docs, bucket=16).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(WORD, r.text or ""))
    want = plain_targets(sizes)
    by_size = {}
    for s, n in sizes.items():
        by_size.setdefault(n, set()).add(round(want[s], 6))
    taken = {}
    for r in got:
        assert round(r.target, 6) in by_size[r.source_size]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    for (_, target), n in taken.items():
        assert abs(n - target) < 1.001
    key = lambda x: sorted((r.doc_id or -1, r.size, r.taken) for r in x)
    again = mixing.mixture(docs.repartition(7, F.rand(1)), bucket=7).collect()
    assert key(got) == key(again)


def test_the_mix_itself(docs):
    total = docs.select(mixing.words_of(F.coalesce("text", F.lit(""))).alias("n"), "source").groupBy("source").sum("n").collect()
    mixed = mixing.apply_mixture(docs)
    assert mixed.columns == docs.columns
    got = mixed.select(mixing.words_of(F.col("text")).alias("n"), "source").groupBy("source").sum("n").collect()
    want = plain_targets({r[0]: r[1] for r in total})
    assert {r[0]: r[1] for r in got} == {s: int(t + 1e-9) for s, t in want.items() if int(t + 1e-9)}
    rows = docs.collect()
    texts = {r.text for r in rows if r.text}
    assert all(any(t.startswith(r.text) for t in texts) for r in mixed.collect())
    # a document's whole copies are at most its epochs, and one document a source is cut
    whole = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    had = Counter((r.doc_id, r.text, r.source) for r in rows)
    assert sum(k not in had for k in whole) <= len(want)
    assert all(n <= 2 * had[k] for k, n in whole.items() if k in had)


@pytest.mark.parametrize("copies", [3, 4096])
def test_a_third_of_all_rows_are_equal(spark, copies):
    rows = [(None, "one two three", "en", "a", 0)] * 500 + [(i, "w " * (i % 9), "en", "b" if i % 3 else "a", 0) for i in range(900)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", size string, taken int, h1 int")
    got = mixing.mixture(docs, copies=copies).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    equal = Counter(r.taken for r in got if r.doc_id is None)
    assert len(equal) <= 3 and max(equal) <= 6
    sums, plans = Counter(), {}
    for r in got:
        sums[r.source_size] += r.taken
        plans[r.source_size] = r.target
    assert all(sums[k] == int(plans[k]) for k in plans)
    mixed = mixing.apply_mixture(docs, copies=copies)
    assert mixed.columns == docs.columns
    words = mixed.select(mixing.words_of(F.col("text")).alias("n"), "source").groupBy("source").sum("n").collect()
    assert sorted(r[1] for r in words) == sorted(sums.values())


def test_many_sources(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 9)), "en", f"s{rnd.randrange(400)}", 0) for i in range(3000)]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = plain_targets(sizes)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_words(spark):
    texts = ["", " ", "a", " a b\tc\nd\x0be\x0cf\rg ", "ü\x1cx y z", "w www w"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.words_of(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(WORD, t)) for t in texts]


def test_empty(spark, docs):
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.apply_mixture(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0)], SCHEMA)
    assert mixing.mixture(blank).first().taken == 0


def test_cut_in_a_long_text(spark):
    long = spark.createDataFrame([("word  " * 60_000,)], "text string")
    cut = long.select(mixing.first_words(F.col("text"), F.lit(59_999)).alias("t")).first().t
    assert cut == ("word  " * 59_999).rstrip()
