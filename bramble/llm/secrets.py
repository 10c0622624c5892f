"""Secret scans: three patterns, and random strings by character Markov models.

The base patterns find assignments, access keys and runs of hexadecimal digits. Then,
in what they leave of each run of 16 or more characters of the base64 and base64url
alphabets, pairs of neighbouring characters are scored by their log-likelihood ratio
under two first-order Markov models, one of random strings and one of ordinary
identifiers. A stretch begins where the running sum leaves zero and ends at its
largest value, once the sum has fallen from there by `DROP` or to zero; if that value
is above the thresholds, in all and for each character, the stretch is a span of the
kind `random`. So a secret behind an ordinary prefix is found without the prefix. The
models are counts of character pairs in labelled samples.

All steps are DataFrame operations on one row at a time; there is no shuffle apart
from the training counts. Work on a text grows with its length and, for n matches,
with n times the root of n. Places are in code points, ends exclusive. Null texts count
as empty: no spans, and the hash of the empty string. Repeated rows each have their
result; other columns are ignored. An empty input gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import LOWER, UPPER, let, text_of

#: Kind, pattern, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # runs are taken whole, so a least length in the pattern drops the same runs
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Of what the base patterns would take, nothing; else, as its group, a run up to the next place where one of them begins.
_TAKEN = "|".join(re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern) for _, pattern, *_ in BASE)
_SIGN = "[A-Za-z0-9+/_=-]"
RUN = rf"{_TAKEN}|(?={_SIGN}{{16}})((?:(?!{_TAKEN}){_SIGN}){{16,}}+)"  # sixteen signs are looked for first: most words end before
SHORTEST = 16
ALPHABET = LOWER + UPPER + "0123456789"
#: Rows of a table: the alphabet's characters from 1, anything else 0.
SIZE = len(ALPHABET) + 1
LEAST, LEAST_EACH, DROP = 12.0, 0.45, 6.0
#: Values that running sums take in at once.
CHUNK = 32
#: Parts of ordinary identifiers for the labelled sample.
PARTS = tuple("access account active address admin after application argument array async background base before binary block buffer build button cache callback case channel character check child class client collection color column command comment config connection constant container content context control count create current cursor data database date default delete description destination device dictionary directory display document domain element email enable encode entry environment error event example exception execute export expression factory failure feature field file filter final find first folder format frame function generate global group handler header height hidden identifier image import index information initial input instance integer interface internal invalid invoice item iterator job json key label language last layout length level library limit line link list listener load local location login manager map margin master match maximum memory message method minimum mode model module mouse name network next node notification number object offset open operation option order output override package page panel parameter parent parse path pattern payment person phone picture pixel player point pointer policy pool position prefix previous primary print private process product profile program project property protected provider public query queue random range reader record reference register remote remove render report request require reset resource response result return role root route sample schedule schema screen script search section select sequence server service session setting shape shared signature simple single size socket source stack start state static status storage stream string structure style submit subscription success summary support switch symbol system table target task template text thread time title toggle total transaction transform type unique update upload user utility validate value variable vector version video view virtual visible warning widget width window worker wrapper write zone".split())


def labelled_samples(spark: SparkSession, prose: DataFrame | None = None, n: int = 6000) -> DataFrame:
    """token, random: n generated random strings and n identifiers. prose(text): ordinary texts whose words join the identifiers, at most n rows."""
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    wide = F.substring(F.regexp_replace(plain, "[+/=]", ""), F.lit(1), (20 + F.col("id") % 22).cast("int"))
    narrow = F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+/=a-z]", ""), 1, 24))
    token = F.when(F.col("id") % 4 == 0, narrow).when(F.col("id") % 4 == 1, plain).otherwise(wide)
    random = rows.select(token.alias("token"), F.lit(1).alias("random"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = [F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(4)]
    lower = [F.array_join(F.array(*pick), s) for s in ("_", "-", "", "/")]
    camel = F.concat(pick[0], *(F.initcap(p) for p in pick[1:]))
    numbered = F.concat(lower[0], F.lit("_"), (F.col("id") % 1000).cast("string"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 7 % 12000).cast("int"))
    dated = [F.concat(day.cast("string"), F.lit("_"), lower[0]), F.concat(lower[1], F.lit("-"), F.date_format(day, "yyyyMMdd")), F.date_format(day, "yyyy-MM-dd-HH-mm")]
    sign = F.substring(F.lit("-=_/+*" + ALPHABET), (F.col("id") % (len(ALPHABET) + 6) + 1).cast("int"), F.lit(1))
    number = F.lpad(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 14), 16, 10), 16, "0")
    forms = [*dated, F.repeat(sign, F.lit(24)), F.repeat(F.substring(F.lit("-=_/+"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)), F.lit(32)), number, *lower, camel, F.initcap(camel), F.upper(lower[0]), F.upper(lower[2]), numbered, F.concat(camel, (F.col("id") % 100).cast("string"))]
    form = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    both = random.union(rows.select(form.alias("token"), F.lit(0).alias("random")))
    if prose is None:
        return both
    some = prose.select(text_of().alias("text")).orderBy(F.xxhash64("text"), "text").limit(n)
    words = some.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("token"))
    return both.union(words.select("token", F.lit(0).alias("random"))).union(words.select(F.upper("token"), F.lit(0).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against identifier, row by row; labelled rows give SIZE * SIZE * 2 counts at most."""
    places = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = samples.where(F.length("token") > 1).select("random", places.alias("p")).select("random", F.explode(F.arrays_zip(F.expr("slice(p, 1, size(p) - 1)").alias("a"), F.expr("slice(p, 2, size(p) - 1)").alias("b"))).alias("x"))
    counts = {(r.random, r.a, r.b): r["n"] for r in pairs.groupBy("random", "x.a", "x.b").agg(F.count("*").alias("n")).collect()}
    table = []
    rows = {(kind, a): sum(counts.get((kind, a, b), 0) for b in range(SIZE)) for kind in (0, 1) for a in range(SIZE)}
    for a in range(SIZE):
        for b in range(SIZE):
            one, two = ((counts.get((kind, a, b), 0) + smoothing) / (rows[kind, a] + smoothing * SIZE) for kind in (1, 0))
            table.append(round(math.log(one / two), 6))
    return table


def _pairs(token: Column, body) -> Column:
    """body of the cells of the table that the token's pairs of neighbours have, in order."""
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    cells = lambda p: F.transform(F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b")), lambda x: x["a"] * SIZE + x["b"])
    return let(places, lambda p: body(cells(p)))


def _weights(table: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "array<double>")


def ratio(token: Column, table: list[float]) -> Column:
    """The token's log-likelihood ratio."""
    return _pairs(token, lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, x: s + F.get(_weights(table), x)))


def stretches(token: Column, table: list[float], least: float = LEAST, least_each: float = LEAST_EACH, drop: float = DROP) -> Column:
    """The random stretches of a run: an array of (start, end)."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("found"))

    def closed(s: Column) -> Column:
        size = s["end"] - s["start"]
        enough = (s["best"] >= least) & (s["best"] >= least_each * size) & (size >= SHORTEST)
        return F.when(enough, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["found"])

    def step(s: Column, cell: Column) -> Column:
        after = s["i"] + 1
        total = s["sum"] + F.get(_weights(table), cell)
        over = (total <= 0) | (total < s["best"] - drop)
        more = total > s["best"]
        kept = F.struct(after.alias("i"), s["start"].alias("start"), total.alias("sum"), F.when(more, total).otherwise(s["best"]).alias("best"), F.when(more, after + 1).otherwise(s["end"]).alias("end"), s["found"].alias("found"))
        return F.when(over, F.struct(after.alias("i"), after.alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), after.alias("end"), closed(s).alias("found"))).otherwise(kept)

    return _pairs(token, lambda cells: F.aggregate(cells, start, step, closed))


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def running_sums(values: Column) -> Column:
    """The sum up to and with each value of an array. Chunks of its root's size are summed first, so no long array grows value by value."""
    none = F.array().cast("array<int>")

    def sums(part: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])

    def chunked(v: Column) -> Column:
        return let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(CHUNK)), lambda n: in_chunks(v, n))

    def in_chunks(v: Column, n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda c: F.slice(v, c * n + 1, n))
        return let(parts, lambda ps: let(F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x)), lambda whole: put_together(ps, whole)))

    def put_together(ps: Column, whole: Column) -> Column:
        return let(sums(whole, F.lit(0)), lambda upto: F.flatten(F.transform(ps, lambda p, c: sums(p, F.get(upto, c) - F.get(whole, c)))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(chunked(v)))


def matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of the leftmost, not overlapping matches whose group is long enough. Places follow from the lengths of the matches and of what lies between."""
    none = F.array().cast(_SPANS)

    def placed(found: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        parts = F.arrays_zip(found.alias("m"), groups.alias("g"), running_sums(sizes).alias("end"))
        kept = F.filter(parts, lambda x: F.length(x["g"]) >= least)
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def scan(docs: DataFrame, table: list[float], least: float = LEAST, least_each: float = LEAST_EACH) -> DataFrame:
    """doc_id, base and random spans of every text: arrays of (start, kind, end, value), each by start, then kind."""
    rows = docs.select("doc_id", text_of().alias("text"))
    base = F.concat(*(matches(F.col("text"), pattern, k, group, n) for k, (_, pattern, group, n) in enumerate(BASE)))
    rows = rows.select("doc_id", F.sort_array(base).alias("base"), matches(F.col("text"), RUN, len(BASE), 1, SHORTEST).alias("runs"))

    def spans(run: Column) -> Column:
        part = lambda x: F.substring(run["value"], x["start"] + 1, x["end"] - x["start"])
        found = stretches(run["value"], table, least, least_each)
        return F.transform(found, lambda x: F.struct((run["start"] + x["start"]).alias("start"), F.lit(len(BASE)).alias("kind"), (run["start"] + x["end"]).alias("end"), part(x).alias("value")))

    return rows.select("doc_id", "base", F.flatten(F.transform("runs", spans)).alias("random"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(x) for x in (*(k for k, *_ in BASE), "random")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest of scan()'s rows."""
    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    count = [number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    every = F.sort_array(F.concat("base", "random"))
    return found.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("random").cast("long").alias("n_random"))
