"""Small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from bramble.functions import names, postings
from bramble.operators import graph, ids, search, storage, topk, workload
from bramble.operators.numbering import numbered, running_sum
from bramble.plans import schemes
from bramble.plans.built import build
from bramble.sources import writers

# Small graphs, scores and words whose answers are known.
SIX = [(0, 1), (0, 2), (0, 4), (0, 5), (1, 2), (1, 3), (2, 4), (2, 5)]
COVERAGE = [(4, x) for x in (1, 2, 5, 8, 10)] + [(10, x) for x in (1, 2, 3, 4, 5, 6)]
SCORES = {1: 0, 2: 2, 3: 5, 4: 8, 5: 6, 6: 10, 8: 3, 10: 9}
WORDS = ["ciao", "miao", "micio", "mocio"]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbours(six):
    one = {d for s, d in pairs(graph.expand(six, 1)) if s == 0}
    two = {d for s, d in pairs(graph.expand(six, 2)) if s == 0}
    assert one == {1, 2, 4, 5} and two == {1, 2, 3, 4, 5}


def test_expansion_against_search(spark):
    rnd = random.Random(1)
    edges = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(70)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    for k in (1, 2, 3, 4):
        want = set()
        for u in {s for s, _ in edges}:
            seen, front = set(), {u}
            for _ in range(k):
                front = {d for s, d in edges if s in front}
                seen |= front
            want |= {(u, v) for v in seen if k == 1 or v != u}
        assert pairs(graph.expand(df, k)) == sorted(want)
    chosen = spark.createDataFrame([(3,), (4,)], "src long")
    assert {s for s, _ in pairs(graph.expand(df, 2, chosen))} <= {3, 4}


def test_self_loops(spark):
    loops = spark.createDataFrame([(1, 1), (2, 1), (2, 3)], "src long, dst long")
    assert (1, 1) in pairs(graph.expand(loops, 1)) and (1, 1) not in pairs(graph.expand(loops, 2))
    assert pairs(graph.expansion_sizes(loops, 2)) == [(1, 0), (2, 2)]


def test_score_streams(spark):
    scored = spark.createDataFrame([(s, d, SCORES[d]) for s, d in COVERAGE], "src long, dst long, score long")
    queries = spark.createDataFrame([(4, 4, 0, 23), (10, 10, 0, 23), (11, 10, 2, 5)], "qid long, u long, l long, r long")
    got = {}
    for r in topk.stream(queries, scored).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.v, r.score))
    assert got[4] == [(10, 9), (5, 6), (8, 3), (2, 2), (1, 0)]
    assert got[10] == [(6, 10), (4, 8), (5, 6), (3, 5), (2, 2), (1, 0)]
    assert got[11] == [(4, 8), (3, 5), (2, 2)]


def test_dictionary(spark):
    d = ids.by_name(spark.createDataFrame([(i, w) for i, w in enumerate(reversed(WORDS))], "uid long, name string"))
    assert [ids.rank(d, w).first()[0] for w in ("ciao", "mocio", "none")] == [0, 3, -1]
    assert ids.select(d, 0).first().name == "ciao"
    assert [tuple(ids.prefix_range(d, p).first()) for p in ("ciao", "m", "zoo", "")] == [(0, 1), (1, 4), (-1, -1), (0, 4)]


def test_equal_names_go_by_the_id_as_text(spark):
    d = ids.by_name(spark.createDataFrame([(2, "a"), (10, "a"), (1, "b")], "uid long, name string"))
    assert [r.uid for r in d.orderBy("sid").collect()] == [10, 2, 1]


def test_prefix_cdf(spark):
    words = spark.createDataFrame([(w,) for w in ["ciao", "come", "stai?", "sto", "stupendamente", "suca!"]], "name string")
    one = {r.prefix: r.cdf for r in workload.prefix_cdf(words, 1).collect()}
    two = {r.prefix: r.cdf for r in workload.prefix_cdf(words, 2).collect()}
    assert one == {"c": pytest.approx(2 / 6), "s": 1.0}
    assert two == {"ci": pytest.approx(1 / 6), "co": pytest.approx(2 / 6), "st": pytest.approx(5 / 6), "su": 1.0}


def test_translation(spark):
    mapping = spark.createDataFrame([(7, 0), (8, 1)], "uid long, sid long")
    edges = spark.createDataFrame([(7, 8), (8, 9), (9, 9), (7, 7)], "src long, dst long")
    assert pairs(ids.translate(edges, mapping, ["src", "dst"])) == [(0, 0), (0, 1)]
    assert {r.column_name: r.errors for r in ids.untranslated(edges, mapping, ["src", "dst"]).collect()} == {"src": 1, "dst": 2}


def test_numbers(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", i) for i in range(1000)], "k string, v long").repartition(7)
    assert all(r.n == r.v for r in numbered(rows, "n", F.col("k")).collect())
    assert all(r.s == r.v * (r.v - 1) // 2 for r in running_sum(rows, "s", F.col("v"), F.col("v")).collect())
    assert numbered(rows.limit(0), "n", F.col("k")).count() == 0


def test_greedy_buckets(spark):
    rnd = random.Random(2)
    users = [(i, rnd.choice([1, 1, 1, 2, 3, 9, 40])) for i in range(300)]
    got = {r.uid: r.bucket for r in workload.user_buckets(spark.createDataFrame(users, "uid long, deg long"), 10).collect()}
    order, total, at, want = sorted(users, key=lambda x: (x[1], x[0])), sum(d for _, d in users), 0, {}
    for b in range(10):
        mass = 0
        while at < len(order) and 10 * mass < total:
            want[order[at][0]] = b
            mass += order[at][1]
            at += 1
    assert got == want


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(5)
    people = [(i, "".join(rnd.choices("ab", k=rnd.randint(1, 4)))) for i in range(60)]
    raw = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(400)} | {(7, x) for x in range(60)})
    from bramble.plans.built import build

    b = build(spark.createDataFrame(people, "uid long, name string"), spark.createDataFrame(raw, "src long, dst long"))
    prefixes = ["", "a", "b", "ab", "bb", "aba", "zz"]
    users = [r.sid for r in b.ids.collect()]
    queries = [(k, u, p) for k, (u, p) in enumerate((u, p) for u in users for p in prefixes)]
    return b, spark.createDataFrame(queries, "qid long, u long, prefix string"), queries


def test_all_schemes_agree_with_plain_search(spark, world):
    b, df, queries = world
    name = {r.sid: r["name"] for r in b.ids.collect()}
    score = {r.sid: r.score for r in b.ids.collect()}
    out = {}
    for r in b.edges.collect():
        out.setdefault(r.src, []).append(r.dst)
    friend, fof, best = set(), set(), set()
    for q, u, p in queries:
        near = [v for v in out.get(u, []) if name[v].startswith(p)]
        friend |= {(q, v) for v in near}
        far = {v for w in [u, *out.get(u, [])] for v in out.get(w, []) if v != u and name[v].startswith(p)} if u in out else set()
        fof |= {(q, v) for v in far}
        best |= {(q, k + 1, v, score[v]) for k, v in enumerate(sorted(far, key=lambda v: -score[v])[:3])}
    ranged = search.with_ranges(df, b.ids, 4)
    assert pairs(search.friend(ranged, b.edges).select("qid", "v")) == sorted(friend)
    assert pairs(search.fof(ranged, b.edges).select("qid", "v")) == sorted(fof)
    assert pairs(search.truth(df, b.two, b.ids).select("qid", "v")) == sorted(fof)
    count = {r.qid: r.results for r in search.counts(df, search.fof(ranged, b.edges)).collect()}
    assert len(count) == len(queries) and sum(count.values()) == len(fof)
    for got in (
        topk.hopping(ranged, b.edges, b.scored, 3),
        topk.wand(ranged, b.edges, b.scored, b.bounds, 3, first=1),
        topk.rmq(ranged, b.edges, b.scored, 3),
        topk.rmq_wand(ranged, b.edges, b.scored, b.bounds, graph.out_degree(b.edges), 3, threshold=8),
    ):
        assert pairs(got) == sorted(best)


def test_baselines(spark, world):
    b, df, queries = world
    both = b.ids.join(b.remap, "uid")
    by_id = df.join(both.select(F.col("sid").alias("u"), "id"), "u").drop("u").withColumnRenamed("id", "u").where("prefix <> ''")
    back = both.select(F.col("id").alias("v"), "sid")
    sids = lambda hits: pairs(hits.join(back, "v").select("qid", "sid"))
    named, rank = search.candidates(b.ids, b.remap, 4), both.select("id", "sid")
    plain = search.with_ranges(df.where("prefix <> ''"), b.ids, 4)
    ranged = search.with_ranges(by_id, b.ids, 4)
    friend, fof = pairs(search.friend(plain, b.edges).select("qid", "v")), pairs(search.fof(plain, b.edges).select("qid", "v"))
    assert sids(search.friend_baseline(by_id, b.compact, named)) == friend == sids(search.friend_fast_baseline(ranged, b.compact, rank))
    assert sids(search.fof_baseline(by_id, b.compact, named)) == fof == sids(search.fof_fast_baseline(ranged, b.compact, rank))


def test_index_round_trip(spark, world, tmp_path):
    b, *_ = world
    storage.write_index(b.edges, str(tmp_path / "n1"), b.ids.select("sid", "score"))
    stored = storage.open_index(spark, str(tmp_path / "n1"))
    assert tuple(storage.verify(b.edges, stored.postings).first()) == (0, 0)
    assert tuple(storage.verify(b.edges.where("src > 3"), stored.postings).first())[0] == 0 < storage.verify(b.edges.where("src > 3"), stored.postings).first().unexpected
    assert pairs(stored.nodes.select("src", "bound")) == pairs(b.bounds)
    assert pairs(storage.gap_decode(storage.gap_encode(b.edges))) == pairs(b.edges)
    sizes = {r.codec: r.bits_per_doc for r in storage.index_stats(b.edges).collect()}
    assert min(sizes, key=sizes.get) in ("ef", "block_interpolative") and sizes["fixed"] == max(sizes.values())


def test_posting_functions(spark):
    rnd = random.Random(3)
    lists = [sorted(rnd.sample(range(2000), 100)) for _ in range(20)] + [[], [5]]
    df = spark.createDataFrame([(x, 1000) for x in lists], "ids array<long>, bound long")
    got = df.select("ids", postings.from_gaps(postings.gaps(F.col("ids"))).alias("again"), postings.next_geq(F.col("ids"), F.col("bound")).alias("n"), postings.between(F.col("ids"), F.lit(10), F.lit(500)).alias("part"), postings.from_monotone(postings.monotone(F.col("ids"))).alias("mono")).collect()
    for r in got:
        assert r.again == r.ids == r.mono
        assert r.n == next((x for x in r.ids if x >= 1000), None)
        assert r.part == [x for x in r.ids if 10 <= x < 500]
    merged = spark.createDataFrame([([[1, 3], [2, 3], [5]], 3)], "x array<array<long>>, u long").select(postings.merged(F.col("x"), F.col("u")).alias("m")).first().m
    assert merged == [1, 2, 5]


def test_names(spark):
    df = spark.createDataFrame([("ab",), ("Zé",), ("",)], "s string")
    got = [tuple(r) for r in df.select(names.successor_of(F.col("s")), names.lower_ascii(F.col("s")), names.is_ascii(F.col("s"))).collect()]
    assert got == [("6163", "ab", True), ("5AC3AA", "zé", False), ("", "", True)]
    assert spark.range(1).select(names.binary_name(F.lit(5), 6)).first()[0] == "...:.:"
    assert names and df.select(F.size(names.all_prefixes(F.col("s"), 5)).alias("n")).agg(F.sum("n")).first()[0] == 4


def test_fill_missing(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    attrs = spark.createDataFrame([(1, "x"), (3, "y"), (4, ""), (77, "outside")], "uid long, name string")
    rows = {r.id: r for r in workload.fill_missing(nodes, attrs).collect()}
    assert len(rows) == 10 and rows[1]["name"] == "x" and rows[3]["name"] == "y"
    filled = [rows[i]["name"] for i in (0, 2, 4, 5, 6, 7, 8, 9)]
    assert sorted(filled) == ["x"] * 4 + ["y"] * 4 and filled[0] != filled[1]


def test_samples(spark):
    degrees = spark.createDataFrame([(i, i % 9) for i in range(200)], "uid long, deg long")
    some = workload.users_by_degree(degrees, 50)
    assert some.count() == 50 and some.where("deg = 0").count() == 0
    modal = [workload.users_by_degree(spark.createDataFrame([(1, 900), (2, 50), (3, 50)], "uid long, deg long"), 1, seed).first().uid for seed in range(30)]
    assert modal.count(1) >= 20
    dealt = workload.user_buckets(degrees.where("deg > 0"), 4)
    assert {r.bucket: r.n for r in workload.users_by_bucket(dealt, 5).groupBy("bucket").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 5)


def test_schemes_by_name(spark, world):
    from bramble.plans import schemes

    b, _, _ = world
    uids = [r.uid for r in b.ids.collect()]
    asked = spark.createDataFrame([(10 * u + k, u, p) for u in uids for k, p in enumerate(["a", "ba", "", "zz"])], "qid long, uid long, prefix string")
    friend = pairs(schemes.run(b, asked, "asindex"))
    fof = pairs(schemes.run(b, asked, "hopping"))
    best = pairs(schemes.run(b, asked, "topk-hopping", 3))
    assert friend and fof and best
    for name, want in (("baseline-asindex", friend), ("fast-baseline-asindex", friend), ("baseline-hopping", fof), ("fast-baseline-hopping", fof)):
        assert pairs(schemes.run(b, asked, name)) == want
    for name in ("topk-hopping-wand", "topk-hopping-rmq", "topk-hopping-rmq-wand"):
        assert pairs(schemes.run(b, asked, name, 3, threshold=5)) == best
    for args, error in ((("coverage",), NotImplementedError), (("n2asarray",), ValueError), (("hopping", 5), ValueError), (("topk-hopping",), ValueError)):
        with pytest.raises(error):
            schemes.run(b, asked, *args)


def test_truth(spark):
    nodes = spark.createDataFrame([(7, 2, 10), (8, 0, 30), (9, 1, 20)], "uid long, sid long, score long")
    asked = spark.createDataFrame([(1, [7, 8, 9, 99]), (2, [])], "qid long, truth array<bigint>")
    assert {r.qid: r.truth for r in workload.truth_by_number(asked, nodes).collect()} == {1: [0, 1, 2], 2: []}
    assert {r.qid: r.truth for r in workload.truth_by_number(asked, nodes, 2).collect()} == {1: [0, 1], 2: []}


def test_attribute_cdf(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "attribute string, n long")
    assert [(r.attribute, r.share) for r in workload.attribute_cdf(counts).orderBy("share").collect()] == [("b", 0.2), ("c", 0.4), ("a", 1.0)]
    assert {r.attribute: r.share for r in workload.attribute_cdf(counts, cumulative=False).collect()} == {"a": 0.6, "b": 0.2, "c": 0.2}


@pytest.mark.parametrize("scheme", ["asindex", "fast-baseline-asindex", "baseline-asindex"])
def test_long_prefixes_match(spark, scheme):
    from bramble.plans import built, schemes

    names = spark.createDataFrame([(1, "b"), (2, "a" * 100), (3, "a" * 99 + "c")], "uid long, name string")
    b = built.build(names, spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))
    asked = spark.createDataFrame([(1, 1, "a" * 80), (2, 1, "a" * 100), (3, 1, "a" * 101)], "qid long, uid long, prefix string")
    sid = {r.uid: r.sid for r in b.ids.collect()}
    assert pairs(schemes.run(b, asked, scheme)) == sorted([(1, sid[2]), (1, sid[3]), (2, sid[2])])


def test_rmq_buckets(spark):
    edges = spark.createDataFrame([(s, 3 * s + k) for s in range(3) for k in range(3)], "src long, dst long")
    assert pairs(storage.rmq_buckets(edges, 6)) == [(0, 0, 0), (1, 0, 0), (2, 1, 6)]


def test_bytes(spark):
    rnd = random.Random(9)
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5] + [rnd.randrange(2**50) for _ in range(20)]

    def varint(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n % 128 + 128]), n >> 7
        return out + bytes([n])

    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", postings.varint(F.col("v")).alias("a"), postings.little_endian(F.col("v"), 8).alias("b")).collect():
        assert bytes.fromhex(r.a) == varint(r.v) and bytes.fromhex(r.b) == r.v.to_bytes(8, "little")
    lists = [[rnd.randbytes(rnd.choice([0, 1, 127, 128, 300, 20_000])) for _ in range(4)] for _ in range(12)]
    df = spark.createDataFrame([([x.hex().upper() for x in parts],) for parts in lists], "p array<string>")
    for r, parts in zip(df.select(postings.pack(F.col("p")).alias("p")).select("p", *(postings.unpack(F.col("p"), k).alias(f"u{k}") for k in range(4))).collect(), lists, strict=True):
        assert bytes.fromhex(r.p) == b"".join(varint(len(x)) + x for x in parts)
        assert [bytes.fromhex(r[f"u{k}"]) for k in range(4)] == parts


def test_codec_sizes(spark):
    edges = spark.createDataFrame([(0, k) for k in range(300)] + [(1, 299)], "src long, dst long")
    bits = {r.codec: r.bits for r in storage.index_stats(edges).collect()}
    # the first list holds the whole universe of 300; the second one id of it
    assert bits["single"] == 0 + (8 + 2 + 1)
    assert bits["uniform"] == 3 * 64 + 64 + (8 + 2 + 1)
    assert bits["block_optpfor"] == 3 * 8 + 8 + 9  # gaps of zero need no bits; a gap of 299 needs nine
    assert bits["block_interpolative"] == 0 + 10  # log2(300) + 299 log2(300 / 299), rounded up
    assert bits["fixed"] == 64 * 301 + 64 * 2


@pytest.fixture(scope="module")
def people(spark):
    """A built graph, its nodes' names, and the neighbours of each."""
    rnd = random.Random(5)
    named = {i: rnd.choice("ab") + rnd.choice("abc") + rnd.choice(["", "x"]) for i in range(30)}
    edges = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(90)})
    out = {u: {d for s, d in edges if s == u} for u in sorted({u for e in edges for u in e})}
    return build(spark.createDataFrame(list(named.items()), "uid long, name string"), spark.createDataFrame(edges, "src long, dst long")), named, out


@pytest.mark.parametrize("scheme", ["asindex", "fast-baseline-asindex", "hopping", "baseline-hopping", "topk-hopping-rmq", "topk-hopping-rmq-wand"])
def test_search_runs_verify(spark, people, scheme):
    b, named, out = people
    asked, size = [], {}
    for u in out:
        for prefix in ("", "a", "bc", "zz"):
            near = set(out[u])
            if "hopping" in scheme:
                near = (near | {d for v in near for d in out.get(v, ())}) - {u}
            truth = sorted(v for v in near if named[v].startswith(prefix))
            asked.append((len(asked), u, prefix, truth))
            size[u, prefix] = min(3, len(truth)) if scheme.startswith("topk") else len(truth)
    queries = spark.createDataFrame(asked, "qid long, uid long, prefix string, truth array<bigint>")
    k = 3 if scheme.startswith("topk") else 0
    rows = schemes.search_run(b, queries, scheme, k, iterations=1).collect()
    assert {(r.user_id, r["query"]): r.results for r in rows} == size and len(rows) == len(size)
    assert all((r.l, r.r) == (-1, -1) for r in rows if r["query"] == "zz") and all(r.prefix_ns > 0 and r.inter_ns > 0 for r in rows)


def test_wrong_results_are_noticed(spark, people):
    queries = spark.createDataFrame([(0, 1, "zz", [5])], "qid long, uid long, prefix string, truth array<bigint>")
    with pytest.raises(schemes.WrongResults, match="missing"):
        schemes.search_run(people[0], queries, "asindex", iterations=1)


def test_truth_and_repeated_draws(spark):
    ids_ = spark.createDataFrame([(10, 0, "aa"), (11, 1, "ab"), (12, 2, "b")], "uid long, sid long, name string")
    pairs_ = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 1)], "src long, dst long")
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "u long, prefix string")
    assert pairs(workload.truth_of(asked, pairs_, ids_)) == [(0, "a", [11]), (0, "b", [12]), (1, "a", [10, 11])]
    drawn = workload.sample_repeated(pairs_, ids_, 1, 2, each=200).collect()
    assert len(drawn) == 2 * 2 * 200 - 0 and {r.prefix for r in drawn if r.u == 1 and r.length == 1} == {"a"}
    share = sum(r.prefix == "a" for r in drawn if r.u == 0 and r.length == 1) / 200
    assert 0.35 < share < 0.65


def test_power_law_graph(spark):
    got = {tuple(r) for r in workload.power_law_graph(spark, 500, 5).collect()}
    assert {(b, a) for a, b in got} == got and {a for a, _ in got} == set(range(500)) and all(a != b for a, b in got)
    degree = sorted((sum(a == n for a, _ in got) for n in range(500)), reverse=True)
    assert degree[0] > 60 > 12 > degree[250]


def test_latex(spark):
    text = writers.latex(spark.createDataFrame([("a_b", 1.5, None)], "scheme string, us double, n int"))
    assert r"a\_b & 1.500 &  \\" in text and text.startswith(r"\begin{tabular}{lll}")
