import math
import random
import re
from collections import Counter

import pytest

from bramble.llm import quality
from bramble.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = re.findall(WORD, text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    lines = [s for s in text.split("\n") if re.search(WORD, s)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    total = 0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(total, 0))


def classes(text):
    counts = [len(re.findall(c, text)) for c in (r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")]
    return [c / max(len(text), 1) for c in [*counts, len(text) - sum(counts)]]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    words = "the of house running to tree and field in light a water stone is that".split()
    rows = [(i, "\n".join(" ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 9]))) + rnd.choice(["", ".", " ü "]) for _ in range(rnd.randint(0, 25))), rnd.choice(["en", "en", "xx", None]), "s", 0) for i in range(200)]
    rows += [(300, None, "en", "s", 0), (301, "", None, None, None), (None, "a b c a b c", "en", "s", 0), (302, "a a a a", "en", "s", 0), (303, "\n\n \nx\nx\n x", "en", "s", 0), (304, "$$ ## ** && %% || << >> " * 40, "en", "s", 0), (304, "$$ ## ** && %% || << >> " * 40, "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_and_distances(docs):
    rows = docs.collect()
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    by_lang = {}
    for r in rows:
        if plain(r.text or "")[0] >= quality.GUARD:
            by_lang.setdefault(r.lang, []).append(classes(r.text))
    for r in rows:
        g, want = got[r.doc_id], plain(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)
        if want[0] >= quality.GUARD:
            mean = [sum(x) / len(x) for x in zip(*by_lang[r.lang], strict=True)]
            assert g.char_distance == pytest.approx(distance(classes(r.text), mean))
            assert (g.word_distance is None) == (r.lang != "en")
        else:
            assert g.char_distance is None and g.word_distance is None


def test_common_words(docs):
    got = {r.doc_id: r.common for r in quality.features(docs).collect() if r.lang == "en"}
    for r in docs.collect():
        if r.lang == "en":
            words = re.findall(WORD, r.text or "")
            assert got[r.doc_id] == [words.count(w) for w in quality.COMMON["en"]]


def test_row_count_and_empty(docs):
    assert quality.judge(docs).count() == docs.count()
    assert quality.judge(docs.limit(0)).count() == 0


def test_labelled_tables(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{small}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) == len(good)


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(40_000))
    r = quality.judge(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).first()
    assert r.n_words == 40_000 and r.n_repeat_words == 40_000 and not r.kept


def test_clashing_columns_and_repeated_rows(spark, docs):
    plain = {(r.doc_id, r.n_words, r.kept): 0 for r in quality.judge(docs).collect()}
    more = docs.selectExpr("*", "1 as n_words", "'x' as rest", "2 as left0", "'y' as c", "3 as l2", "4 as a0", "false as kept")
    got = quality.judge(more).collect()
    assert {(r.doc_id, r.n_words, r.kept) for r in got} == plain.keys()
    twice = quality.judge(docs.union(docs))
    assert twice.count() == 2 * docs.count() and {(r.doc_id, r.n_words, r.kept) for r in twice.collect()} == plain.keys()
