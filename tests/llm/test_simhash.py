import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bramble.llm import simhash
from bramble.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    import re

    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius):
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {p: find(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBß \t\n\x0b\x0c\r\x1c Çé", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('der die das') h").first().h
    assert got == signed(xxhash.xxh64_intdigest(b"der die das", seed=42))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tables_cover_every_pair(radius):
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    rnd = random.Random(1)
    for _ in range(3000):
        gone = sum(1 << i for i in rnd.sample(range(64), radius))
        assert any(gone & m == 0 for m in tables)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_and_components(spark, radius):
    rnd = random.Random(3)
    points = {0, (1 << 64) - 1, *(rnd.getrandbits(64) for _ in range(20))}
    for _ in range(4):  # crowded neighbourhoods, and chains
        centre = rnd.getrandbits(64)
        points |= {centre ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 2))) for _ in range(40)}
        for _ in range(15):
            centre ^= sum(1 << i for i in rnd.sample(range(64), radius))
            points.add(centre)
    want = plain_components(sorted(points), radius)
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"), radius)
    rows = edges.collect()
    assert all(((r.u & (2**64 - 1)) ^ (r.v & (2**64 - 1))).bit_count() <= radius and r.u < r.v for r in rows)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for p, k in want.items():
        groups.setdefault(k, set()).add(signed(p))
    for g in groups.values():
        assert {roots.get(p, p) for p in g} == {min(g)}


def test_whole_operator(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 80, 300]))) for _ in range(40)]
    texts += [texts[3], texts[3] + " ", texts[5].upper(), "", None, " \n ", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None), (7, texts[7], "en", "s", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t, *_ in rows:
        prints.setdefault(plain_fingerprint(t or ""), []).append(i)
    roots = plain_components(sorted(prints), 2)
    least = {}
    for p, ids in prints.items():
        least[roots[p]] = min([x for x in ids if x is not None] + ([least[roots[p]]] if roots[p] in least else []))
    texts_by_id = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        fp = r.fp & (2**64 - 1)
        if r.doc_id is not None:
            assert fp == plain_fingerprint(texts_by_id[r.doc_id] or "")
        assert r["first"].doc_id == least[roots[fp]]


def test_query_against_all_pairs(spark):
    """The components of every pair of fingerprints within two bits, over the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = simhash.near_duplicates(docs, ["doc_id"]).select("doc_id", "fp", F.col("first.doc_id").alias("root")).toPandas()
    prints = np.unique(got["fp"].to_numpy())
    bits = prints.view(np.uint64)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 2).tolist():
            parent[find(i)] = find(i + 1 + j)
    group = {p: find(i) for i, p in enumerate(prints.tolist())}
    least = got.assign(g=got["fp"].map(group)).groupby("g")["doc_id"].min()
    assert (got["fp"].map(group).map(least) == got["root"]).all() and len(least) < len(prints)


def test_copies_with_changed_words_go(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        words = rnd.choices(vocabulary, k=200)
        for c in range(4):
            mine = list(words)
            for _ in range(c):
                mine[rnd.randrange(200)] = rnd.choice(vocabulary)
            rows.append((100 * g + c, " ".join(mine), "en", "s", 0))
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert {i for i in kept if i % 100 == 0} == {100 * g for g in range(40)}
    assert len(kept) <= 43


def test_many_near_copies(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k:]), "en", "s", 0) for i in range(400) for k in [rnd.randrange(300)]]
    rows += [(1000 + i, " ".join(f"{a}{i}" for a in words), "en", "s", 0) for i in range(100)]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert {i for i in kept if i >= 1000} == {1000 + i for i in range(100)}
    assert sum(i < 1000 for i in kept) <= 3


def shingles(text, width=5):
    words = simhash.bare_words(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rnd, words, vocabulary, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return words


def test_signature_estimates_similarity():
    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(4000)]
    far = 0
    for n in (20, 80, 300, 3000):
        for k in range(30):
            words = rnd.choices(vocabulary, k=n)
            a, b = " ".join(words), " ".join(edited(rnd, words, vocabulary, n * k // 300))
            x, y = (np.frombuffer(simhash.sketches_and_signature(t)[1], np.uint8) for t in (a, b))
            told = (same := ((x == y) & (x != 0)).sum()) / max(1, ((x != 0) | (y != 0)).sum())
            assert simhash.alike(x[None], y, 0.5)[0] == (told >= 0.5) and same >= 0
            far += abs(told - jaccard(shingles(a), shingles(b))) > 0.15
    assert far <= 4


def test_sketches_against_plain_python():
    text = "Over, and over again: the Longest_word of ALL wins! ß"
    words = dict.fromkeys(simhash.bare_words(text))
    assert list(words) == [b"over", b"and", b"again", b"the", b"longest_word", b"of", b"all", b"wins", "ß".encode()]

    def mix(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * by % 2**64
        return x ^ (x >> 31)

    made, _ = simhash.sketches_and_signature(text)
    for k, sketch in enumerate(made):
        sums = [0] * 48
        for w in words:
            h = mix((xxhash.xxh64_intdigest(w, 42) + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64) >> 16
            for bit in range(48):
                sums[bit] += max(1, 4 * (min(len(w), 12) - 3)) * (1 if h >> bit & 1 else -1)
        assert sketch == sum(1 << bit for bit in range(48) if sums[bit] > 0)
    assert simhash.sketches_and_signature(" \n")[1] == bytes(simhash.BINS)


@pytest.mark.parametrize("crowd", [3, 7, 8192])
def test_all_pairs_of_a_bucket_are_compared(spark, crowd):
    rnd = random.Random(11)
    base = [bytes(rnd.randrange(1, 256) for _ in range(simhash.BINS)) for _ in range(6)]
    made = []
    for b in base:  # chains whose ends are unlike
        for _ in range(9):
            b = bytes(rnd.randrange(1, 256) if rnd.random() < 0.3 else x for x in b)
            made.append(b)
    rows = [(i, i, [5, 9], s) for i, s in enumerate(made)]
    edges = simhash.similar(spark.createDataFrame(rows, "t long, node long, sketches array<bigint>, signature binary"), crowd=crowd)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(made):
        for j, y in enumerate(made):
            if sum(a == b for a, b in zip(x, y, strict=True)) >= 0.5 * simhash.BINS:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert 1 < len({find(i) for i in range(len(made))}) <= 6
    assert [roots.get(i, i) for i in range(len(made))] == [find(i) for i in range(len(made))]


def test_a_crowd_of_copies_is_compared_in_rows_linear_in_its_members(spark, monkeypatch):
    rnd, rows, kept = random.Random(23), [], simhash.crossed
    alike = lambda base, share: bytes(rnd.randrange(1, 256) if rnd.random() < share else x for x in base)
    base, lone = (bytes(rnd.randrange(1, 256) for _ in range(simhash.BINS)) for _ in range(2))
    made = [alike(base, 0.1) for _ in range(200)] + [alike(lone, 0.1) for _ in range(2)] + [bytes(rnd.randrange(1, 256) for _ in range(simhash.BINS)) for _ in range(2)]
    monkeypatch.setattr(simhash, "crossed", lambda *a: rows.append(kept(*a)) or rows[-1])
    texts = spark.createDataFrame([(i, i, [5], s) for i, s in enumerate(made)], "t long, node long, sketches array<bigint>, signature binary")
    roots = {r.node: r.root for r in simhash.components(simhash.similar(texts, crowd=10)).collect()}
    assert [roots.get(i, i) for i in range(204)] == [0] * 200 + [200, 200, 202, 203]
    assert 0 < rows[0].count() <= 21  # one for each of the 21 parts


@pytest.mark.parametrize("few", [0, simhash.FEW])
def test_components_by_rounds_and_by_one_task(spark, few):
    rnd = random.Random(29)
    nodes = [rnd.randrange(-(2**62), 2**62) for _ in range(300)]
    pairs = [*zip(nodes[:60], nodes[1:61], strict=True), *((nodes[70], x) for x in nodes[71:130]), *(tuple(rnd.sample(nodes[130:], 2)) for _ in range(90))]
    pairs = [(min(p), max(p)) for p in pairs]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs + pairs[:9], "u long, v long"), few).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    assert got == {x: find(x) for x in parent}
    assert simhash.components(spark.createDataFrame([], "u long, v long"), few).count() == 0


@pytest.mark.parametrize("crowd", [3, 8192])
def test_later_sketches_join_what_the_first_leave_apart(spark, crowd):
    rnd = random.Random(31)
    made = []
    for b in [bytes(rnd.randrange(1, 256) for _ in range(simhash.BINS)) for _ in range(5)]:
        for _ in range(14):  # chains whose ends are unlike
            b = bytes(rnd.randrange(1, 256) if rnd.random() < 0.3 else x for x in b)
            made.append((b, [rnd.choice([0x0F, 0xF0F0, 0x333333]) for _ in range(3)]))
    rows = [(i, i, x, s) for i, (s, x) in enumerate(made)]
    edges = simhash.similar(spark.createDataFrame(rows, "t long, node long, sketches array<bigint>, signature binary"), crowd=crowd, ahead=1)
    got = {r.node: r.root for r in simhash.components(edges).collect()}

    def joined(n):
        parent = list(range(len(made)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (s, x) in enumerate(made):
            for j, (t, y) in enumerate(made[:i]):
                if any((a ^ b) & m == 0 for a, b in zip(x[:n], y[:n], strict=True) for m in simhash.masks(2, 48)) and sum(map(int.__eq__, s, t)) >= 0.5 * simhash.BINS:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(made))]

    assert [got.get(i, i) for i in range(len(made))] == joined(3) != joined(1)


def test_a_crowd_of_near_copies_meets_in_few_buckets(spark, monkeypatch):
    """Of its 112 buckets a text goes into the comparison with those that its group isn't joined before; rows are linear in the group."""
    rnd, words, kept, seen = random.Random(37), [f"word{i}" for i in range(80)], simhash._linked, []
    monkeypatch.setattr(simhash, "_linked", lambda rows, least: seen.append(rows.agg(F.sum(F.size("m")).alias("n")).first().n or 0) or kept(rows, least))
    took = {}
    for n in (200, 400):
        seen.clear()
        docs = spark.createDataFrame([(i, " ".join(edited(rnd, words, [f"other{k}" for k in range(5000)], 2)), "en", "s", 0) for i in range(n)], SCHEMA)
        assert len({r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}) <= n // 50
        took[n] = sum(seen)
    assert 0 < took[400] <= 30 * 400 and took[400] <= 2.5 * took[200]


def test_recall_by_similarity(spark):
    """Of pairs of texts with a five-word similarity of 0.7 or more, nearly all lose one; of those below 0.3, none do."""
    rnd = random.Random(17)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 11))) for _ in range(3000)]
    common = vocabulary[:40]
    rows, bands = [], {}
    for g in range(700):
        n = rnd.choice([60, 150, 250, 450])
        words = [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(n)]
        other = edited(rnd, words, vocabulary, max(1, round(n * rnd.choice([0.01, 0.02, 0.03, 0.05, 0.2, 0.4]))))
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * g, a, "en", "s", 0), (2 * g + 1, b, "en", "s", 0)]
        bands.setdefault(int(10 * jaccard(shingles(a), shingles(b))), []).append(g)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(2 * g in kept for g in range(700))
    caught = {b: sum(2 * g + 1 not in kept for g in gs) / len(gs) for b, gs in bands.items()}
    high = [g for b, gs in bands.items() if b >= 8 for g in gs]
    assert len(high) > 50 and sum(2 * g + 1 not in kept for g in high) >= 0.99 * len(high)
    assert len(bands[7]) > 30 and caught[7] >= 0.95
    assert all(caught[b] == 0 for b in bands if b <= 2)


def test_long_texts_over_a_small_vocabulary(spark):
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(1000)]
    rows = []
    for g in range(40):
        words = rnd.choices(vocabulary, k=10_000)
        rows += [(2 * g, " ".join(words), "en", "s", 0), (2 * g + 1, " ".join(edited(rnd, words, vocabulary, 150)), "en", "s", 0)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(0, 80, 2))


def test_links_of_any_member_link_its_group(spark, monkeypatch):
    # 1 and 2 are within the radius; 3 meets 2 only, and 4 meets nothing
    one, two = bytes([7]) * simhash.BINS, bytes([9]) * simhash.BINS
    made = spark.createDataFrame([(1, 0, [1 << 40], two), (2, 3, [0x5555], one), (3, 0x7FF, [0x5555], one), (4, 0x7F, [3], one)], "id long, fp long, sketches array<bigint>, signature binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, keys, more=0: docs.select(*keys).join(made, "id"))
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 0) for i in (1, 2, 3, 4)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 4]


def test_one_stays(spark):
    rows = [(2, "a b c d", "en", "s", 1), (1, "a b c d", "de", "s", 1), (1, "a b c d", "de", "s", 1), (None, "a b c d", None, None, None), (None, "x y z v", None, None, None), (9, "", None, "t", 0), (8, None, None, "t", 0)]
    docs = spark.createDataFrame([(*r, k, 1.0) for k, r in enumerate(rows)], SCHEMA + ", h1 int, fp double")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, "x y z v"), (1, "a b c d"), (8, "")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none, ["doc_id"]).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def test_many_copies_and_a_very_long_text(spark):
    long = "word " * 300_000
    rows = [(i, "the same text here", "en", "s", 0) for i in range(3000)] + [(5000, long, "en", "s", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), ["doc_id"])
    assert got.where("first.doc_id = 0").count() == 3000
    assert got.where("doc_id = 5000").first().fp == signed(xxhash.xxh64_intdigest(b"word word word", seed=42))
