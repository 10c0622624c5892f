import math
import random
import time
import zlib

import numpy as np
import pytest

from bramble.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    calm = [f"{a}{b}" for a in ("ran", "tel", "mor", "sid", "pol") for b in ("ing", "ed", "er", "ly", "on")]
    rude = ["blorg", "snarp", "zoggit"]
    rows, labels = [], []
    for i in range(900):
        words = rnd.choices(calm, k=60)
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(60), rnd.choice(rude))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    got = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 900
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98


def test_held_out_labels_are_not_read(corpus):
    docs, labels, _ = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (dict(toxicity.toxicity(docs, toxicity.train(docs, x)).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_edges(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.train(docs, labels.union(labels.sparkSession.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "blorg " * 100_000, 3), (2, "blorg " * 100_000, 3), (3, "!!!", 3)], "doc_id long, text string, score int")
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[1].held_out
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and {r.text for r in kept.collect()} >= {None, ""}
    assert toxicity.toxicity(odd.limit(0), model).count() == 0
    nothing = toxicity.train(docs.limit(0), labels)
    assert {r.score < 0.5 for r in toxicity.toxicity(odd, nothing).collect()} == {True}


def plain_isotonic(margins, y):
    """Min-max formula of the isotonic regression over the distinct margins, with the same shrinkage of the pooled blocks."""
    keys = sorted(set(margins))
    sums = [[sum(v for m, v in zip(margins, y, strict=True) if m == k), sum(m == k for m in margins)] for k in keys]
    mean = lambda i, j: sum(s for s, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1])
    raw = [max(min(mean(i, j) for j in range(k, len(keys))) for i in range(k + 1)) for k in range(len(keys))]
    base = sum(y) / (len(y) + 1)
    out = []
    for r in raw:
        n = sum(c for (_, c), x in zip(sums, raw, strict=True) if abs(x - r) < 1e-12)
        out.append((r * n + 0.2 * base) / (n + 0.2))
    return keys, list(np.maximum.accumulate(out))


def test_isotonic_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(1, 14)
        margins, y = [rnd.randint(0, 9) / 2 for _ in range(n)], [float(rnd.random() < 0.5) for _ in range(n)]
        at, value = toxicity.isotonic(np.array(margins), np.array(y))
        keys, want = plain_isotonic(margins, y)
        assert np.interp(keys, at, value) == pytest.approx(want)


def test_first_split_against_brute_force():
    rnd = np.random.default_rng(8)
    for _ in range(20):
        x = rnd.integers(0, 6, (40, 3)).astype(float)
        y = (rnd.random(40) < 0.4).astype(float)
        g, h = 0.5 - y, np.full(40, 0.25)
        edges = [np.unique(c)[:-1] for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        tree = toxicity.grow(x, g, h, 1, edges, binned, 1.0)

        def gain(f, cut):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < 5:
                return 0.0
            part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
            return part(left) + part(~left) - part(np.ones(40, bool))

        best = max(gain(f, cut) for f in range(3) for cut in edges[f])
        if len(tree[0]) == 4:
            assert gain(tree[0][0], tree[0][1]) == pytest.approx(best)
            left = x[:, tree[0][0]] <= tree[0][1]
            values = toxicity.tree_values(tree, x)
            assert values[left] == pytest.approx(-g[left].sum() / (h[left].sum() + 1)) and values[~left] == pytest.approx(-g[~left].sum() / (h[~left].sum() + 1))
        else:
            assert best <= 1e-6


def test_features_against_plain_python():
    model = toxicity.Model({"blorg": 4.0, "zog": 3.0}, {"snar": 2.5}, 0.0)
    text = "You BLORG! the snarps and snarpy folk saw a zog; far from all of it, b1org? yessss"
    got = dict(zip(toxicity.FEATURES, model.features(text), strict=True))
    found = ["you", "blorg", "the", "snarps", "and", "snarpy", "folk", "saw", "a", "zog", "far", "from", "all", "of", "it", "b1org", "yessss", "biorg"]
    assert toxicity.tokens(text) == found
    n, letters = len(found), sum(map(len, found))
    assert got["words"] == pytest.approx(np.log1p(n)) and got["hits"] == 2 and got["distinct"] == 2 and got["density"] == pytest.approx(200 / n)
    assert got["strongest"] == 4.0 and got["stem_hits"] == 2 and got["stem_density"] == pytest.approx(200 / n)
    assert got["near_second_person"] == 3 and got["second_person"] == pytest.approx(1 / n)  # blorg, snarps and snarpy within five words of you
    assert got["capitals"] == pytest.approx(6 / letters) and got["punctuation"] == pytest.approx(4 / len(text))
    assert got["exclamations"] == pytest.approx(100 / len(text)) and got["obfuscated"] == pytest.approx(1 / n) and got["long_repeats"] == pytest.approx(1 / n)


def test_terms_against_plain_counts(spark):
    rnd = random.Random(5)
    rows = [(f"t{k}", rnd.randint(0, 30), 0) for k in range(40)]
    rows = [(t, a, a + rnd.randint(0, 60)) for t, a, _ in rows]
    got = {r.term: r.weight for r in toxicity.weighed(spark.createDataFrame(rows, "term string, a long, n long"), 900, 90).collect()}
    want = {}
    for t, a, n in rows:
        if a >= 4 and (a - 0.5 - n * 0.1) / math.sqrt(n * 0.09) > 5 and (w := math.log((a + 0.5) * 0.9 / ((n - a + 0.5) * 0.1))) > 2.5:
            want[t] = w
    assert want and got == pytest.approx(want)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(3, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 2).collect()
    assert len(rows) == 2 == len({r.doc_id for r in rows})
    assert all(int(r.text.split()[1]) % 7 == r.doc_id for r in rows)


def test_very_long_masked_runs():
    text = "x1y" * 100_000 + " so $tupid"
    began = time.time()
    found = toxicity.tokens(text)
    assert found[0] == "x1y" * 100_000 and found[-2:] == ["xiy" * 100_000, "stupid"] and time.time() - began < 10
    assert toxicity.tokens("a1b/" * 2)[2:] == ["aib", "aib"]


def test_isotonic_and_trees():
    at, value = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert list(value) == sorted(value) and list(at) == sorted(at)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    base, trees = toxicity.boost(x, y)
    m = toxicity.Model(base=base, trees=trees).margins(x)
    assert ((m > 0) == y).mean() > 0.9


def test_obfuscated_words():
    assert toxicity.tokens("you id1ot, 1d10t") == ["you", "id1ot", "1d10t", "idiot", "idiot"]
    assert "stupid" in toxicity.tokens("so $tupid!")
