import bz2
import gzip

from pyspark.sql import functions as F

from bramble.operators import report
from bramble.sources import readers, writers


def put(path, text, opener=gzip.open):
    with opener(path, "wb") as f:
        f.write(text.encode())
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges(spark, tmp_path):
    text = "0\t1\n0\t2\n1\t3\n2\t0"
    for name, opener in (("e.tsv.gz", gzip.open), ("e.tsv.bz2", bz2.open), ("e.tsv", open)):
        assert rows(readers.edges(spark, put(tmp_path / name, text, opener))) == [(0, 1), (0, 2), (1, 3), (2, 0)]
    assert rows(readers.edges_by_source(spark, str(tmp_path / "e.tsv"))) == [(0, [1, 2]), (1, [3]), (2, [0])]


def test_vectors(spark, tmp_path):
    path = put(tmp_path / "ids.gz", "".join(f"{i * 3}\n" for i in range(500)))
    assert rows(readers.vector(spark, path)) == [(i, i * 3) for i in range(500)]
    assert rows(readers.id_mapping(spark, path))[1] == (3, 1)
    assert rows(readers.ranking(spark, put(tmp_path / "r.gz", "1\t5\n2\t6\n1\t7\n"))) == [(1, 7), (2, 6)]


def test_raw_datasets(spark, tmp_path):
    e, a = readers.dblp(spark, put(tmp_path / "a.edges.gz", "1\t2\n1\t2\n"), put(tmp_path / "a.nodes.gz", 'Ann "B"\t1\nÉva\t2\n'))
    assert rows(e) == [(1, 2)] and rows(a) == [(1, 'ann "b"'), (2, "Éva")]
    e, a = readers.livejournal(spark, put(tmp_path / "l.gz", "% sym unweighted\n% 2 4 4\n# head\n1 2\n3\t4\n"), put(tmp_path / "l.names.gz", "Bob|1\nAnn|2\n"))
    assert rows(e) == [(1, 2), (3, 4)] and rows(a) == [(1, "bob"), (2, "ann")]
    e, a = readers.twitter(spark, put(tmp_path / "t.gz", "1\t2\n"), put(tmp_path / "t.names.gz", "1 BoB\n2 É\n3  cy\n"))
    assert rows(e) == [(2, 1)] and rows(a) == [(1, "bob"), (3, "cy")]


def test_results_and_queries(spark, tmp_path):
    made = spark.createDataFrame([(i, u, "ab"[:n], 0, 5, 3, 1000 * (i + 1), 2000 * u) for i in range(3) for u in (1, 2) for n in (1, 2)], "iteration int, user_id long, query string, l int, r int, results long, prefix_ns long, inter_ns long")
    writers.results(made, str(tmp_path / "a.perf"))
    back = readers.results(spark, f"{tmp_path}/a.perf,{tmp_path}/a.perf")
    assert back.count() == 24 and rows(back.distinct()) == rows(made)
    t = report.timing(report.kept(made, skip=1, query_len=2).withColumn("scheme", F.lit("s"))).first()
    assert (t.n, t.prefix_us, t.inter_us, t.inter_var) == (2, 2.5, 3.0, 1.0)
    w = report.by_length(made.withColumn("scheme", F.lit("s"))).first()
    assert w.len1 == 3.0 and w.len3 is None
    writers.report(made, str(tmp_path / "report"))
    q = spark.createDataFrame([(1, 5, "ab", [1, 2]), (2, 6, "", [])], "qid long, uid long, prefix string, truth array<bigint>")
    writers.queries(q, str(tmp_path / "q"))
    assert rows(readers.queries(spark, str(tmp_path / "q"))) == rows(q)
    writers.dictionary(spark.createDataFrame([(0, "a"), (1, "b")], "sid long, name string"), str(tmp_path / "dict"))
    assert spark.read.parquet(str(tmp_path / "dict")).count() == 2


def test_spaces_and_empty_names_survive(spark, tmp_path):
    names = spark.createDataFrame([(1, " a "), (2, 'b "c"'), (3, "d  ")], "uid long, name string")
    writers.attributes(names, str(tmp_path / "n"))
    assert rows(readers.attributes(spark, str(tmp_path / "n"))) == rows(names)
    made = spark.createDataFrame([(0, 1, q, -1, -1, 0, 5, 6) for q in ("", " a", "b ")], "iteration int, user_id long, query string, l int, r int, results long, prefix_ns long, inter_ns long")
    writers.results(made, str(tmp_path / "r.perf"))
    assert rows(readers.results(spark, str(tmp_path / "r.perf"))) == rows(made)
    writers.edges(spark.createDataFrame([(2, 1), (0, 5)], "src long, dst long"), str(tmp_path / "e"))
    assert rows(readers.edges(spark, str(tmp_path / "e"))) == [(0, 5), (2, 1)]


def test_query_files(spark, tmp_path):
    asked = [(5, "a", [3, 4]), (5, "ab", []), (6, "", [9])]
    df = spark.createDataFrame(asked, "uid long, prefix string, truth array<bigint>")
    for flag in (True, False):
        writers.query_files(df, str(tmp_path / f"q{flag}"), flag)
        assert rows(readers.query_files(spark, str(tmp_path / f"q{flag}"))) == [(u, p, t if flag else None) for u, p, t in asked]
