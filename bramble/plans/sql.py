"""DuckDB SQL for the registered queries, over the raw tables."""

from __future__ import annotations

from bramble.plans.built import LONGEST, SHORTEST
from bramble.plans.queries import BLOCK, BUCKETS, K, PREFIX, RMQ

#: Common table expressions that queries build on, in dependency order.
_PARTS = {
    "attrs": "SELECT p_partkey AS uid, lower(p_name) AS name FROM part",
    "raw": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'",
    "ids": "SELECT uid, name, row_number() OVER (ORDER BY name, CAST(uid AS VARCHAR)) - 1 AS sid, row_number() OVER (ORDER BY md5(CAST(uid AS VARCHAR)), uid) - 1 AS score FROM attrs",
    "edges": "SELECT s.sid AS src, t.sid AS dst FROM raw JOIN ids s ON raw.src = s.uid JOIN ids t ON raw.dst = t.uid",
    "remap": "SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS id FROM (SELECT src AS uid FROM raw UNION SELECT dst FROM raw)",
    "scored": "SELECT src, dst, score FROM edges JOIN ids ON dst = sid",
    "degrees": "SELECT src, count(*) AS deg FROM edges GROUP BY src",
    "uni": "SELECT greatest(max(src), max(dst)) + 1 AS u FROM edges",
    "two": "SELECT src, dst FROM (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src) WHERE src <> dst",
    "sampled": f"""SELECT u, length, prefix, truth_count FROM (
        SELECT *, row_number() OVER (PARTITION BY u, length ORDER BY -ln(('0x' || substr(md5('42:' || u || ':' || length || ':' || prefix), 1, 8))::BIGINT / 4294967296.0 + 1e-10) / truth_count, prefix) AS place
        FROM (SELECT two.src AS u, n AS length, substr(name, 1, n) AS prefix, count(*) AS truth_count FROM two JOIN ids ON two.dst = ids.sid, range({SHORTEST}, {LONGEST} + 1) r(n) GROUP BY ALL)
      ) WHERE place = 1""",
    "work": "SELECT u * 10 + length AS qid, u, prefix FROM sampled",
    "hits1": "SELECT qid, u, dst AS v FROM work JOIN edges ON u = src JOIN ids ON dst = sid WHERE starts_with(name, prefix)",
    "hits2": "SELECT qid, u, dst AS v FROM work JOIN two ON u = src JOIN ids ON dst = sid WHERE starts_with(name, prefix)",
    "best": f"SELECT qid, rank, v, score FROM (SELECT qid, v, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, v DESC) AS rank FROM hits2 JOIN ids ON v = sid) WHERE rank <= {K}",
    "udeg": "SELECT src AS uid, count(*) AS deg FROM raw GROUP BY src",
    "masses": "SELECT uid, deg, row_number() OVER w AS pos, sum(deg) OVER w AS cum, sum(deg) OVER () AS total FROM udeg WINDOW w AS (ORDER BY deg, uid ROWS UNBOUNDED PRECEDING)",
    "gaps": "SELECT src, row_number() OVER w - 1 AS position, dst - coalesce(lag(dst) OVER w, -1) - 1 AS gap, dst FROM edges WINDOW w AS (PARTITION BY src ORDER BY dst)",
    "coded": "SELECT src, count(*) AS n, sum(CASE " + " ".join(f"WHEN gap < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)::BIGINT AS bytes FROM gaps GROUP BY src",
    "parts": "SELECT src, position // 128 AS block, count(*) AS n, (sum(gap) + count(*))::BIGINT AS span, " + ", ".join(f"count(*) FILTER (gap >= {1 << b}) AS o{b}" for b in range(33)) + " FROM gaps GROUP BY ALL",
    "truths": "SELECT qid, work.u, prefix, ids.uid FROM work JOIN two ON u = two.src JOIN ids ON two.dst = ids.sid WHERE starts_with(name, prefix)",
    "counted": f"SELECT two.src AS u, n AS length, substr(name, 1, n) AS prefix, count(*) AS truth_count FROM two JOIN ids ON two.dst = ids.sid, range({SHORTEST}, {LONGEST} + 1) r(n) GROUP BY ALL",
    "varints": "SELECT src, string_agg(array_to_string(list_transform(range((CASE " + " ".join(f"WHEN gap < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)), lambda i: printf('%02X', (gap >> (7 * i)::INT) % 128 + CASE WHEN gap >> (7 * i + 7)::INT > 0 THEN 128 ELSE 0 END)), ''), '' ORDER BY position) AS bytes, count(*) AS n FROM gaps GROUP BY src",
    "lists": "SELECT src, deg AS n, u FROM degrees, uni",
    "runs": """SELECT scheme, iteration, u AS user_id, prefix AS query, (400 * length(prefix) + iteration)::BIGINT AS prefix_ns,
        (CASE scheme WHEN 'hopping' THEN 700 ELSE 300 END * coalesce(results, 0) + 1000 * length(prefix) + 10 * iteration)::BIGINT AS inter_ns
      FROM work LEFT JOIN (SELECT qid, count(*) AS results FROM hits2 GROUP BY qid) USING (qid), range(4) r(iteration), (VALUES ('hopping'), ('asindex')) s(scheme)""",
    "meaned": "SELECT scheme, user_id, query, avg(prefix_ns / 1000) AS prefix, avg(inter_ns / 1000) AS inter FROM runs WHERE iteration >= 1 GROUP BY ALL",
}
_NEEDS = {
    "ids": ["attrs"], "edges": ["raw", "ids"], "remap": ["raw"], "scored": ["edges"], "degrees": ["edges"], "uni": ["edges"], "two": ["edges"],
    "sampled": ["two"], "work": ["sampled"], "hits1": ["work"], "hits2": ["work"], "best": ["hits2"], "udeg": ["raw"], "masses": ["udeg"],
    "gaps": ["edges"], "coded": ["gaps"], "parts": ["gaps"], "truths": ["work"], "counted": ["two"], "varints": ["gaps"], "lists": ["degrees", "uni"], "runs": ["hits2"], "meaned": ["runs"],
}


def _with(text: str, *parts: str, recursive: str = "") -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for n in _NEEDS.get(name, ()):
            add(n)

    for p in parts:
        add(p)
    # used more than once by what follows: computed once
    named = [f"{k} AS MATERIALIZED ({v})" for k, v in _PARTS.items() if k in wanted]
    return f"WITH RECURSIVE {', '.join([*named, recursive] if recursive else named)} {text}" if named else text


_BUCKETS = f"""closed(b, start, stop) AS (
  SELECT 0, 0::BIGINT, (SELECT coalesce(min(pos), (SELECT count(*) FROM masses)) FROM masses WHERE {BUCKETS} * cum >= total)::BIGINT
  UNION ALL
  SELECT b + 1, stop, (SELECT coalesce(min(m.pos), (SELECT count(*) FROM masses)) FROM masses m WHERE m.pos > closed.stop AND {BUCKETS} * (m.cum - coalesce((SELECT x.cum FROM masses x WHERE x.pos = closed.stop), 0)) >= m.total)::BIGINT
  FROM closed WHERE b + 1 < {BUCKETS}
), dealt AS (SELECT uid, deg, b::INT AS bucket FROM masses JOIN closed ON pos > start AND pos <= stop)"""

_FRIEND = _with("SELECT qid, v FROM hits1", "hits1")
_FOF = _with("SELECT qid, v FROM hits2", "hits2")
_TOP = _with("SELECT qid, rank, v, score FROM best", "best")
_BIT = "CASE WHEN log2(u::DOUBLE / n) > 0 THEN floor(log2(u::DOUBLE / n)) ELSE 0 END"

SQL: dict[str, str] = {
    "ids_by_name": _with("SELECT uid, sid, name FROM ids", "ids"),
    "compact_ids": _with("SELECT uid, id FROM remap", "remap"),
    "ranking": _with("SELECT uid, sid, score FROM ids", "ids"),
    "dict_remapping": _with("SELECT sid, id FROM ids JOIN remap USING (uid)", "ids", "remap"),
    "translate_edges": _with("SELECT src, dst FROM edges", "edges"),
    "translate_errors": _with("SELECT 'src' AS column_name, count(*) AS errors FROM raw WHERE src NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'dst', count(*) FROM raw WHERE dst NOT IN (SELECT s_suppkey FROM supplier)", "raw"),
    "prefix_range": _with(f"SELECT coalesce(min(sid), -1) AS l, coalesce(max(sid) + 1, -1) AS r FROM ids WHERE starts_with(name, '{PREFIX}')", "ids"),
    "prefix_range_miss": "SELECT -1::BIGINT AS l, -1::BIGINT AS r",
    "prefix_ranges": _with(f"SELECT substr(name, 1, n) AS prefix, min(sid) AS l, max(sid) + 1 AS r FROM ids, range(1, {LONGEST} + 1) t(n) WHERE n <= length(name) GROUP BY prefix", "ids"),
    "dict_rank": _with("SELECT name, min(sid) AS rank FROM ids GROUP BY name", "ids"),
    "dict_select": _with("SELECT sid, name FROM ids", "ids"),
    "successor": _with(f"SELECT DISTINCT prefix, substr(h, 1, length(h) - 2) || printf('%02X', ('0x' || right(h, 2))::INT + 1) AS successor FROM (SELECT substr(name, 1, n) AS prefix, hex(substr(name, 1, n)) AS h FROM attrs, range(1, {LONGEST} + 1) t(n) WHERE n <= length(name))", "attrs"),
    "ascii_names": r"SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_md5 FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')",
    "out_degree": _with("SELECT src, deg FROM degrees", "degrees"),
    "degree_histogram": _with("SELECT deg, count(*) AS n FROM degrees GROUP BY deg", "degrees"),
    "universe": _with("SELECT u AS universe FROM uni", "uni"),
    "wand_bound": _with("SELECT src, max(score) AS bound FROM scored GROUP BY src", "scored"),
    "cdf_degree": _with("SELECT sid, coalesce(deg, 0) AS degree, coalesce(sum(coalesce(deg, 0) + 1) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cdf_degree FROM ids LEFT JOIN degrees ON sid = src", "ids", "degrees"),
    "dataset_stats": _with("SELECT (SELECT count(*) FROM ids) AS vertices, (SELECT sum(length(name)) FROM ids)::BIGINT AS name_chars, (SELECT count(*) FROM edges) AS edges1, (SELECT count(*) FROM two) AS edges2, (SELECT count(*) FROM edges) / (SELECT count(*) FROM degrees) AS avg_deg1, (SELECT count(*) FROM two) / (SELECT count(*) FROM degrees) AS avg_deg2", "two", "degrees"),
    "adjacency": _with("SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs FROM edges GROUP BY src", "edges"),
    "neighbors_k1": _with("SELECT src, dst FROM edges", "edges"),
    "neighbors_k2": _with("SELECT src, dst FROM two", "two"),
    "neighbors_k3": _with("SELECT DISTINCT src, dst FROM walk WHERE src <> dst", "edges", recursive="walk(src, dst, n) AS (SELECT src, dst, 1 FROM edges UNION SELECT walk.src, e.dst, n + 1 FROM walk JOIN edges e ON walk.dst = e.src WHERE n < 3)"),
    "n2_histogram": _with("SELECT d.src, coalesce(n, 0) AS n FROM degrees d LEFT JOIN (SELECT src, count(*) AS n FROM two GROUP BY src) t USING (src)", "two", "degrees"),
    "n2_total": _with("SELECT count(*) AS total FROM two", "two"),
    "source_filter": _with("SELECT sid AS src, name FROM ids WHERE sid IN (SELECT src FROM edges)", "edges"),
    "invert_graph": _with("SELECT dst AS src, src AS dst FROM edges", "edges"),
    "vertex_set": _with("SELECT src AS id FROM edges UNION SELECT dst FROM edges", "edges"),
    "distinct_neighbor_names": _with("SELECT DISTINCT src, name FROM edges JOIN ids ON dst = sid", "edges"),
    "friend_asindex": _FRIEND,
    "friend_baseline": _FRIEND,
    "friend_fast_baseline": _FRIEND,
    "fof_hopping": _FOF,
    "fof_baseline": _FOF,
    "fof_fast_baseline": _FOF,
    "fof_n2_asindex": _FOF,
    "fof_truth": _FOF,
    "fof_count": _with("SELECT qid, count(v) AS results FROM work LEFT JOIN hits2 USING (qid) GROUP BY qid", "hits2"),
    "topk_hopping": _TOP,
    "topk_wand": _TOP,
    "topk_rmq": _TOP,
    "topk_rmq_wand": _TOP,
    "rmq_stream": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, v) AS place, v, score FROM hits1 JOIN ids ON v = sid", "hits1"),
    "prefix_cdf": _with("SELECT prefix, n, (sum(n) OVER (ORDER BY prefix ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER () AS cdf FROM (SELECT substr(name, 1, 2) AS prefix, count(*) AS n FROM ids GROUP BY prefix)", "ids"),
    "user_buckets": _with("SELECT uid, deg, bucket FROM dealt", "masses", recursive=_BUCKETS),
    "bucket_stats": _with("SELECT bucket, min(deg) AS min_deg, max(deg) AS max_deg, count(*) AS users FROM dealt GROUP BY bucket", "masses", recursive=_BUCKETS),
    "users_by_bucket": _with("SELECT uid, deg, bucket FROM dealt QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY ('0x' || substr(md5('42:' || uid), 1, 8))::BIGINT, uid) <= 100", "masses", recursive=_BUCKETS),
    "users_by_degree": _with("SELECT uid, deg FROM udeg ORDER BY -ln(('0x' || substr(md5('42:' || uid), 1, 8))::BIGINT / 4294967296.0 + 1e-10) / deg, uid LIMIT 1000", "udeg"),
    "sample_queries": _with("SELECT u, length, prefix, truth_count FROM sampled", "sampled"),
    "shuffled_queries": _with("SELECT qid, prefix, row_number() OVER (ORDER BY md5('42:' || qid), qid) - 1 AS place FROM work", "work"),
    "fill_missing": _with("""SELECT id, name, false AS filled FROM named WHERE name IS NOT NULL
        UNION ALL SELECT w.id, d.name, true FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) % (SELECT count(*) FROM named WHERE name IS NOT NULL) AS turn FROM named WHERE name IS NULL) w
        JOIN (SELECT name, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS turn FROM named WHERE name IS NOT NULL) d USING (turn)""",
        "raw", recursive="named AS (SELECT id, lower(s_name) AS name FROM (SELECT src AS id FROM raw UNION SELECT dst FROM raw) LEFT JOIN supplier ON id = s_suppkey)"),
    "gap_encode": _with("SELECT src, position, gap FROM gaps", "gaps"),
    "gap_decode": _with("SELECT src, dst FROM edges", "edges"),
    "monotone_code": _with("SELECT src, (sum(score + 1) - 1)::BIGINT AS last_code, true AS decodes FROM scored GROUP BY src", "scored"),
    "cursor": _with("SELECT src, next_geq, CASE WHEN next_geq IS NULL THEN -1 ELSE (SELECT count(*) FROM edges x WHERE x.src = t.src AND x.dst < next_geq) END::BIGINT AS position, below FROM (SELECT src, min(dst) FILTER (dst >= src // 10) AS next_geq, count(*) FILTER (dst < src) AS below FROM edges GROUP BY src) t", "edges"),
    "block_max": _with(f"SELECT src, position // {BLOCK} AS block, max(dst) AS largest FROM gaps GROUP BY ALL", "gaps"),
    "ef_size_bits": _with(f"SELECT src, n, (n * {_BIT} + 2 * n + 1)::BIGINT AS bits FROM lists", "lists"),
    "varbyte_size": _with("SELECT src, n, bytes FROM coded", "coded"),
    "index_stats": _with(f"""SELECT 'ef' AS codec, count(*) AS docs, sum(n)::BIGINT AS elements, sum(n * {_BIT} + 2 * n + 1)::BIGINT AS bits FROM lists
        UNION ALL SELECT 'single', count(*), sum(n)::BIGINT, sum(CASE WHEN n = u THEN 0 ELSE least(n * {_BIT} + 2 * n + 1, u) END)::BIGINT FROM lists
        UNION ALL SELECT 'uniform', count(DISTINCT src), sum(n)::BIGINT, sum(64 + CASE WHEN n = u THEN 0 ELSE least(n * {_BIT} + 2 * n + 1, u) END)::BIGINT FROM (SELECT src, n, span AS u FROM parts)
        UNION ALL SELECT 'block_optpfor', count(DISTINCT src), sum(n)::BIGINT, sum(8 + least({", ".join(f"n * {b} + o{b} * 40" for b in range(33))}))::BIGINT FROM parts
        UNION ALL SELECT 'block_interpolative', count(*), sum(n)::BIGINT, sum(floor(n * log2(m / n) + CASE WHEN m > n THEN (m - n) * log2(m / (m - n)) ELSE 0 END + 0.999999))::BIGINT FROM (SELECT src, sum(n) AS n, sum(span)::DOUBLE AS m FROM parts GROUP BY src)
        UNION ALL SELECT 'block_varint', count(*), sum(n)::BIGINT, sum(8 * bytes)::BIGINT FROM coded UNION ALL SELECT 'fixed', count(*), sum(n)::BIGINT, sum(64 * (n + 1))::BIGINT FROM lists""", "lists", "coded", "parts"),
    "stored_index": _with("SELECT src, dst, score, deg AS degree, bound FROM scored JOIN degrees USING (src) JOIN (SELECT src, max(score) AS bound FROM scored GROUP BY src) USING (src)", "scored", "degrees"),
    "friend_stored": _FRIEND,
    "verify_stored": "SELECT 0::BIGINT AS missing, 0::BIGINT AS unexpected",
    "sampled_truth": _with("SELECT qid, u, prefix, string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid) AS truth FROM truths GROUP BY ALL", "truths"),
    "sample_repeated": _with("""SELECT u, length, d::INT AS draw, prefix FROM (SELECT *, sum(truth_count) OVER (PARTITION BY u, length ORDER BY prefix ROWS UNBOUNDED PRECEDING) AS upto, sum(truth_count) OVER (PARTITION BY u, length) AS total FROM counted), range(3) r(d)
        WHERE ('0x' || substr(md5('42:' || u || ':' || length || ':' || d), 1, 8))::BIGINT / 4294967296.0 * total >= upto - truth_count AND ('0x' || substr(md5('42:' || u || ':' || length || ':' || d), 1, 8))::BIGINT / 4294967296.0 * total < upto""", "counted"),
    "search_run": _with("""SELECT i::INT AS iteration, uid AS user_id, prefix AS query, l, r, results FROM (SELECT qid, u, prefix, count(*) AS results FROM truths GROUP BY ALL) JOIN ids ON u = sid
        JOIN (SELECT prefix, min(sid) AS l, max(sid) + 1 AS r FROM (SELECT DISTINCT prefix FROM work) JOIN ids ON starts_with(name, prefix) GROUP BY prefix) USING (prefix), range(2) x(i)""", "truths"),
    "read_edges": _with("SELECT src, dst FROM edges", "edges"),
    "read_attributes": "SELECT p_partkey AS uid, lower(p_name) AS name FROM part",
    "read_queries": _with("SELECT s.uid, prefix, string_agg(CAST(t.uid AS VARCHAR), ',' ORDER BY t.uid) AS truth FROM truths t JOIN ids s ON t.u = s.sid GROUP BY qid, s.uid, prefix", "truths"),
    "read_results": _with("SELECT iteration::INT AS iteration, user_id, query, results, prefix_ns, inter_ns FROM (SELECT runs.*, coalesce(n, 0)::BIGINT AS results FROM runs LEFT JOIN (SELECT u, prefix, count(v) AS n FROM work JOIN hits2 USING (qid, u) GROUP BY ALL) c ON c.u = user_id AND c.prefix = query) WHERE scheme = 'hopping'", "runs"),
    "rmq_buckets": _with(f"SELECT src, bucket, min(before) OVER (PARTITION BY bucket) AS first FROM (SELECT src, before, before // {RMQ} AS bucket FROM (SELECT src, coalesce(sum(deg) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM degrees))", "degrees"),
    "raw_sequence": _with("SELECT src, bytes FROM varints", "varints"),
    "packed_lists": _with("""SELECT src, printf('%s%s00%s%s', CASE WHEN k < 128 THEN printf('%02X', k) ELSE printf('%02X%02X', k % 128 + 128, k // 128) END, bytes, '04', size) AS packed, bytes AS part0, '' AS part1, size AS part2
        FROM (SELECT *, length(bytes) // 2 AS k, printf('%02X%02X%02X%02X', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216) AS size FROM varints)""", "varints"),
    "power_law_graph": """WITH u AS (SELECT i, ('0x' || substr(md5('42:' || i || ':' || k), 1, 8))::BIGINT / 4294967296.0 AS x FROM range(1, 1000) a(i), range(5) b(k)), one AS (SELECT i AS src, floor(i * x * x)::BIGINT AS dst FROM u)
        SELECT src, dst FROM one UNION SELECT dst, src FROM one""",
    "verify_index": "SELECT 0::BIGINT AS missing, 0::BIGINT AS unexpected",
    "result_timing": _with("SELECT scheme, count(*) AS n, round(avg(prefix), 4) AS prefix_us, round(var_pop(prefix), 4) AS prefix_var, round(avg(inter), 4) AS inter_us, round(var_pop(inter), 4) AS inter_var FROM meaned GROUP BY scheme", "meaned"),
    "timing_by_length": _with("SELECT scheme, " + ", ".join(f"round(avg(inter) FILTER (length(query) = {n}), 4) AS len{n}" for n in range(1, 6)) + " FROM meaned GROUP BY scheme", "meaned"),
}
