import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from bramble.llm import mixing, packing, queries, simhash, tiling, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert out.columns == docs.columns
        seen[name], docs = out, out
    key = lambda name: Counter(tuple(r) for r in seen[name].collect())
    before, calm, single, clean, mixed = map(key, ("documents", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"))
    # each filter leaves rows as they are, and takes those that its operator names
    model = toxicity.train(seen["documents"], spark.read.parquet(f"{small}/labels.parquet"))
    assert calm == Counter({r: n for r, n in before.items() if model.scores(np.array([model.features(r[1] or "")]))[0] < 0.5})
    assert not single - calm and 0 < sum(single.values()) < sum(calm.values()) and max(single.values()) == 1
    prints = [simhash.fingerprint(r[1] or "") for r in single]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
    judged = {r.doc_id for r in tiling.contamination(seen["simhash_near_dedup"], spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated").collect()}
    assert clean == Counter({r: n for r, n in single.items() if r[0] not in judged})
    words = Counter()
    for r, n in mixed.items():
        words[r[3]] += n * len((r[1] or "").split())
    plan = {r.source: int(r.target) for r in mixing.targets(seen["benchmark_decontamination"].select("source", mixing.words_of(mixing.text_of()).alias("n")).groupBy("source").agg({"n": "sum"}).toDF("source", "source_size")).collect()}
    assert {s: n for s, n in words.items()} == {s: n for s, n in plan.items() if n}
    # the last stage's rows hold every text of the mix
    assert Counter((r.doc_id, r.text) for r in packing.unpack(docs).collect()) == Counter((r[0], r[1] or "") for r in mixed.elements())
    assert all(len(np.frombuffer(r.ids, "<u2")) == packing.ROW for r in docs.collect())
    # run() gives the same documents
    whole = packing.unpack(corpus_pipeline.run(spark, small))
    assert Counter((r.doc_id, r.text) for r in whole.collect()) == Counter((r[0], r[1] or "") for r in mixed.elements())


def tables(spark, at, docs, labels, items):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns."""
    rnd = random.Random(3)
    vocabulary = [f"w{rnd.randrange(10**6)}x" for _ in range(400)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    item = text(12)
    long, once = text(200_000), text(90)
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 0), (None, once, None, None, 1), (None, once, None, None, 1)]
    rows += [(4, long, "en", "a", 9), (5, long, "en", "b", 9), (6, f"{text(30)} {item} {text(30)}", "en", "b", 1)]
    rows += [(10 + i, text(100), "en", rnd.choice(["a", "b", None]), 5) for i in range(40)] + [(77, once, "fr", "a", 1)] * 3
    docs = spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA + ", h1 int, fp long, row string, words int")
    at = tables(spark, tmp_path, docs, [(4, 1, 0), (None, None, None), (5, None, 1), *((10 + i, 1, 0) for i in range(9))], [(1, item), (None, None), (2, "")])
    found = sorted(((r.doc_id, r.text) for r in packing.unpack(corpus_pipeline.run(spark, at)).collect()), key=str)
    texts = {t for _, t in found}
    ids = {i for i, _ in found}
    assert 6 not in ids and 5 not in ids  # the benchmark item; the copy of the larger doc_id
    assert 4 in ids and {10 + i for i in range(40)} & ids
    assert long in texts or any(long.startswith(t) and len(t) > 1000 for t in texts)
    assert (77 in ids) and None not in ids  # of rows that differ in doc_id only, the smallest stays; empty ones take no words


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark", "all"])
def test_empty_tables(spark, tmp_path, empty):
    rows = [(i, f"some words of text number {i} and {i * i} more", "en", "ab"[i % 2], 5) for i in range(30)]
    docs = spark.createDataFrame([] if empty in ("documents", "all") else rows, SCHEMA)
    labels, items = [(1, 1, 0), (2, 0, 1)], [(1, "nothing that any text here holds")]
    at = tables(spark, tmp_path, docs, [] if empty in ("labels", "all") else labels, [] if empty in ("benchmark", "all") else items)
    got = corpus_pipeline.run(spark, at).collect()
    assert bool(got) == (empty not in ("documents", "all"))
    assert all(len(r.ids) == 2 * packing.ROW and r.ids.endswith(tokens.END.to_bytes(2, "little")) for r in got)


def test_registered(spark, small):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and entry.queries().keys() >= queries.QUERIES.keys()
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    for n, sql in queries.SQL.items():
        assert n in queries.QUERIES and sql
