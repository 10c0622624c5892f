import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import lengths, packing, tokens

VOCABULARY = tokens.read_vocabulary()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["the", "heart", "Überraschung", "día", "x1", "##"], k=rnd.choice([0, 1, 5, 60, 700]))) for _ in range(80)]
    texts += [None, "", "a" * 20_000, " " * 9000, "line\n" * 3000, "🙂" * 10]
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")


def plain(text):
    return len(tokens.encoder(VOCABULARY)(text))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    ids = tokens.encoder(VOCABULARY)(text)
    assert tokens.model(VOCABULARY).decode(ids) == text
    assert ids == tokens.model(VOCABULARY).encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t ", "\xa0", "\x1c", "a", "ab1", "!", "é"]), st.integers(1, 9)), max_size=12))
def test_long_runs_change_nothing(parts):
    text = "".join(part * (n * 1000 if n > 4 else n) for part, n in parts)
    assert tokens.encoder(VOCABULARY)(text) == tokens.model(VOCABULARY).encode_ordinary(text)


def test_a_million_characters():
    encode, decode = tokens.encoder(VOCABULARY), tokens.model(VOCABULARY).decode
    for text in (" " * 1_000_000 + "x", "\n" * 1_000_001, "a" * 1_000_000, "some words " * 300_000, "x" + " \n" * 500_000 + " y"):
        assert decode(encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 16), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = packing.best_fit_decreasing(sizes, 16)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 16 for r in rows)
    room, want = [], 0  # the plain search
    for n in sorted(sizes, reverse=True):
        fits = [k for k, free in enumerate(room) if free >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(16 - n)
            want += 1
    assert len(rows) == want


@pytest.mark.parametrize(("row", "block"), [(64, 4_000_000), (64, 500), (2048, 4_000_000)])
def test_pack(docs, row, block):
    packed = packing.pack(docs.repartition(3, "doc_id"), row=row, block=block)
    total = 0
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.piece_starts) == len(r.position_resets)
        assert (ids[r.n_tokens :] == tokens.END).all()
        total += r.n_tokens
    assert total == sum(plain(t or "") + 1 for _, t, _ in docs.collect())
    back = sorted((r.doc_id, r.text) for r in packing.unpack(packed).collect())
    assert back == sorted((i, t or "") for i, t, _ in docs.collect())


def test_pack_again_gives_the_same(docs):
    key = lambda df: sorted((r.shard, r.block, r.row, bytes(r.ids)) for r in df.collect())
    assert key(packing.pack(docs)) == key(packing.pack(docs))


def test_empty(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    assert lengths.suffix_sums(lengths.histogram(docs.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_null_ids(spark, kind):
    rows = [(None, "a b"), (None, "a b"), (None, None), (7, "same " * 300), (7, "same " * 300), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "1 as copies")
    packed = packing.pack(df, row=64)
    back = [(r.doc_id, r.text) for r in packing.unpack(packed).collect()]
    key = lambda x: (str(x[0]), x[1])
    cast = str if kind == "string" else int
    assert sorted(back, key=key) == sorted(((i if i is None else cast(i), t or "") for i, t in rows), key=key)


def test_histogram(spark, docs):
    sizes = [plain(t or "") for _, t, _ in docs.collect()]
    sums = lengths.suffix_sums(lengths.histogram(docs.repartition(5, "doc_id")))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r.n_docs == sizes.count(n) and r.tokens == n * r.n_docs
        assert r.docs_from == sum(s >= n for s in sizes) and r.tokens_from == sum(s for s in sizes if s >= n)
        assert r.tokens_cut_here == sum(min(s, n) for s in sizes)
        assert r.share_up_to == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    for r in lengths.at_limits(sums, [0, 1, 7, 100, 10**6]).collect():
        assert r.docs_cut == sum(s > r.context_limit for s in sizes)
        assert r.tokens_kept == sum(min(s, r.context_limit) for s in sizes)
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in sizes if sum(s <= n for s in sizes) >= r.share * len(sizes) - 1e-9)
    assert sorted(r.n_tokens for r in lengths.token_counts(docs).collect()) == sorted(sizes)
