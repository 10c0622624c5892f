"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A radius r takes 2**(r+1)-1 tables. Bit i of a fingerprint has a nonzero label of
r+1 bits; table v keeps the bits whose label has an odd scalar product with v. Any
r differing bits give r linear equations over r+1 unknowns, which a nonzero v
solves, so that pair agrees on all that table v keeps: no pair within the radius is
missed, whatever the data.

A bucket of two distinct fingerprints is compared directly. The members of larger ones
each name themselves and their neighbours at one bit, 65 points in all; two members
within two bits have such a point in common, and members with a common point are
within two bits. So linking the members of each point in a star gives exactly the
components of all pairs, with rows linear in the members, for a radius of 2 or less.

Rows with the same fingerprint fold into one representative before any table is
built. Null texts count as empty; a text without words has fingerprint zero and is
linked like any other. Long texts are hashed in chunks. An empty input gives an empty
result. A null doc_id is carried; a component's id is the smallest doc_id that is not
null, or null if it has none.

For dropping near copies, whose fingerprints of shingles differ in more bits than
covering tables can take, each text also has further, shorter sketches: SimHashes of
its set of words, where long words weigh more, which a changed word moves less. They
go into covering tables of their own. Rows that meet there are compared by an
estimate of the Jaccard similarity of their sets of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bramble.llm.common import checkpoint, content_keyed, sliced, text_of

SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
#: The increment and the multipliers of the SplitMix64 finalizer.
_STEP, _MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: For dropping near copies: sketches, their bits, and the words of the shingles whose similarity links.
SKETCHES, SKETCH_BITS, WIDTH = 16, 48, 5
#: Copies of a text with one word in thirty changed have a similarity of about 0.7, and 0.5 among each other.
LEAST = 0.5
#: Bytes of the signature from which similarity is estimated, one for each bin of shingle hashes.
BINS = 128
#: Members of a bucket that are compared in one row.
CROWD = 8192
#: Sketches whose buckets are compared first; those of the others are compared for what these leave apart.
AHEAD = 4
#: Edges whose components one task finds, in 0.3 GB or less; more take rounds of joins.
FEW = 1 << 21
#: Shingles whose bits are unpacked at once: 64 bytes each.
CHUNK = 1 << 16
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one whole text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        if len(words) < width:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[at + k : end + k] for k in range(width)), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in _MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def bare_words(text: str) -> list[bytes]:
    """Lower-case (A-Z) words without ASCII punctuation at either end."""
    found = (w.strip(_SIGNS) for w in text.encode("utf-8", "surrogatepass").lower().split())
    return [w for w in found if w]


def sketches_and_signature(text: str, n: int = SKETCHES, bits: int = SKETCH_BITS, bins: int = BINS, width: int = WIDTH) -> tuple[np.ndarray, bytes]:
    """n SimHashes of the set of words, each with its own hash, and a byte for each bin of the shingles' hashes.

    A word's weight grows with its length, from 4 letters to 12: long words are the rare
    ones. A shingle's bin is its hash modulo `bins`; the bin's byte comes from the
    smallest hash in it, and is 0 where the bin is empty.
    """
    import xxhash

    found = bare_words(text)
    if not found:
        return np.zeros(n, dtype=np.int64), bytes(bins)
    place: dict[bytes, int] = {}
    at = np.array([place.setdefault(w, len(place)) for w in found], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    first = np.array([digest(w, SEED) for w in place], dtype=np.uint64)
    weight = np.clip(4 * (np.fromiter(map(len, place), dtype=np.int64, count=len(place)) - 3), 1, 36).astype(np.uint8)
    sums = np.zeros(n * bits, dtype=np.int64)
    steps = np.array([_STEP * (k + 1) % (1 << 64) for k in range(n)], dtype=np.uint64)
    for k in range(0, len(first), 4096):
        h = _mixed(first[k : k + 4096, None] + steps)
        part = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), n, 8)[:, :, : bits // 8].reshape(len(h), -1), axis=1)
        part *= weight[k : k + 4096, None]  # not a matrix product, which would start threads
        sums += part.sum(axis=0, dtype=np.int64)
    ones = (2 * sums > weight.sum(dtype=np.int64)).reshape(n, bits)
    packed = np.zeros((n, 8), dtype=np.uint8)
    packed[:, 8 - bits // 8 :] = np.packbits(ones, axis=1)
    made = packed.view(">u8").astype(np.int64).ravel()

    words, wide = first[at], max(1, len(at) - width + 1)
    h = np.zeros(wide, dtype=np.uint64)
    for k in range(min(width, len(at))):
        h = _mixed(h + words[k : k + wide] + np.uint64(_STEP))
    h = np.unique(h)  # in order, so that the first of each bin is its smallest
    bin_, where = np.unique(h % np.uint64(bins), return_index=True)
    signature = np.zeros(bins, dtype=np.uint8)
    signature[bin_.astype(np.int64)] = h[where] // np.uint64(bins) % np.uint64(255) + np.uint64(1)
    return made, signature.tobytes()


def fingerprints(docs: DataFrame, keys: list[str], width: int = SHINGLE, more: int = 0) -> DataFrame:
    """The key columns, the fingerprint `fp`, as a signed long, and `more` sketches and, with them, the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(len(keys)).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            columns, names = [*b.columns[: len(keys)], pa.array(found.view(np.int64))], [*keys, "fp"]
            if more:
                others = [sketches_and_signature(t, more) for t in texts]
                columns += [pa.array([x.tolist() for x, _ in others], pa.list_(pa.int64())), pa.array([x for _, x in others], pa.binary())]
                names += ["sketches", "signature"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*keys, text_of().alias("text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, fp long" + (", sketches array<bigint>, signature binary" if more else ""))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The kept bits of each table."""
    top = 2 ** (radius + 1)
    return [sum(1 << i for i in range(bits) if ((i % (top - 1) + 1) & v).bit_count() % 2) for v in range(1, top)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v), u < v, that join exactly the components of all pairs of distinct `fp` within the radius."""
    if not 1 <= radius <= 2:
        raise ValueError("the exact bucket step is for a radius of 1 or 2")
    kept = masks(radius)
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for k, m in enumerate(kept)))
    placed = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    buckets = checkpoint(placed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius
    two = buckets.where(F.col("n") == 2).where(near).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    # a fingerprint crowded in several tables names its points once: both ends of a missed pair are crowded
    crowded = placed.join(buckets.where(F.col("n") > 2).select("t", "key"), ["t", "key"]).select("fp").distinct()
    bits = F.array(*(_long(1 << i) for i in range(BITS)))
    if radius == 2:
        points = F.concat(F.array("fp"), F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b)))
    else:  # one bit apart: the pair has the point with that bit cleared in common, and nothing else has
        points = F.transform(bits, lambda b: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(b)).alias("at"), b.alias("bit")))
    named = checkpoint(crowded.select("fp", F.explode(points).alias("point")))
    stars = named.groupBy("point").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u < top").drop("top")
    many = named.join(stars, "point").where("fp > u").select("u", F.col("fp").alias("v"))
    return two.union(many).distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), in order, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # low names roots only; each round hangs those with a smaller neighbour below it
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[low]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while ((up := low[low]) != low).any():
            low = up


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the smallest node of its component.

    Up to `few` edges are joined by one task. More alternate large-star and small-star
    steps; each is one minimum by node and one equi-join, and each round's edges go to
    the checkpoint folder.
    """
    edges, before = checkpoint(edges.select("u", "v")), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            found = roots(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "root"])

    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(run, "node long, root long")
    while True:  # each round lowers some node's smallest neighbour or is the last
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # edges now point from the smaller to the larger node: v's smaller neighbours are all its u
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = checkpoint(small.select(F.col("m").alias("u"), "v").union(small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = tuple(state)


def near_duplicates(docs: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """Of every row: its keys, `fp`, and `first`, the smallest struct of keys in its component."""
    return grouped(checkpoint(fingerprints(docs, keys)), keys, radius)


def grouped(rows: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """The rows with `first`, by the components of their fp."""
    folded = checkpoint(rows.groupBy("fp").agg(F.min(_ranked(keys)).alias("first")))
    return rows.join(firsts(folded, components(links(folded.select("fp"), radius))), "fp")


def _rooted(folded: DataFrame, joined: DataFrame) -> DataFrame:
    return folded.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def firsts(folded: DataFrame, joined: DataFrame) -> DataFrame:
    """fp and the smallest first of its component."""
    rooted = _rooted(folded, joined)
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("first")))  # so that the join has exchanges of its own, which can be split
    return rooted.select("fp", "root").join(least, "root").select("fp", "first")


def alike(signatures: np.ndarray, one: np.ndarray, least: float) -> np.ndarray:
    """Which rows of signatures have an estimated similarity to one of at least `least`: of the bins that either has a shingle in, the share that agree."""
    same = ((signatures == one) & (one != 0)).sum(axis=1)
    either = ((signatures != 0) | (one != 0)).sum(axis=1)
    return same >= least * np.maximum(either, 1)


def bridges(signatures: np.ndarray, node: np.ndarray, cut: int, least: float) -> list[tuple[int, int]]:
    """Pairs of nodes that join exactly the components of all pairs of members that are alike.

    Members of one node count as joined. Where some lie from `cut` on, only pairs of a
    member before it and one from there on count.
    """
    group, found, n = np.unique(node, return_inverse=True)[1], [], len(node)
    for i in range(cut):
        mine, behind = group[i], cut if cut < n else i + 1
        if (group == mine).all():
            break
        open_ = behind + np.flatnonzero(group[behind:] != mine)
        hit = open_[alike(signatures[open_], signatures[i], least)]
        kinds, at = np.unique(group[hit], return_index=True)
        if len(kinds):
            found.extend((int(node[i]), int(x)) for x in node[hit[at]])
            group[np.isin(group, kinds)] = mine
    return found


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """The distinct bridges (u, v), u < v, of rows(m, an array of (node, signature), cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, cuts = [], b.column(2).to_pylist()
            for nodes, signatures, cut in zip(b.column(0), b.column(1), cuts, strict=True):
                made = np.frombuffer(b"".join(signatures.values.to_pylist()), np.uint8).reshape(-1, BINS)
                found += bridges(made, nodes.values.to_numpy(), cut, least)
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], ["u", "v"])

    return rows.select("m.node", "m.signature", "cut").mapInArrow(run, "u long, v long").distinct()


def similar(texts: DataFrame, radius: int = RADIUS, bits: int = SKETCH_BITS, least: float = LEAST, crowd: int = CROWD, ahead: int = AHEAD) -> DataFrame:
    """Pairs (u, v), u < v, of nodes that join exactly the components of all pairs of texts(t, node, sketches, signature) that share a bucket of any covering table and are alike.

    The buckets of the first `ahead` sketches come first. What they join is one node in
    the buckets of the others, and a bucket of one node has nothing to compare: so of a
    crowd of near copies few of the later buckets are left.
    """
    found = checkpoint(_met(texts.withColumn("sketches", F.slice("sketches", 1, ahead)), radius, bits, least, crowd))
    rest = texts.join(components(found), "node", "left").select("t", F.coalesce("root", "node").alias("node"), F.expr(f"slice(sketches, {ahead + 1}, size(sketches))").alias("sketches"), "signature")
    return found.union(_met(checkpoint(rest), radius, bits, least, crowd))


def _met(texts: DataFrame, radius: int, bits: int, least: float, crowd: int) -> DataFrame:
    """The pairs of similar(), by the buckets of all sketches at once.

    Every member of a bucket is compared with every other unless they are joined already,
    but a spanning forest comes back, so rows are linear in the members. Buckets of over
    `crowd` members are dealt into parts; the members of a part meet each other and one
    member that all parts of the bucket meet. What that leaves apart, crossed() compares.
    Buckets of the same members count once. A bucket is named by a hash of its table and
    key, and t is a hash of the text; where hashes meet by chance, more are compared.
    """
    kept = F.array(*map(_long, masks(radius, bits)))
    keys = F.flatten(F.transform("sketches", lambda x, k: F.transform(kept, lambda m, t: F.xxhash64(k * 100 + t, x.bitwiseAND(m)))))
    bucket = Window.partitionBy("b")  # not an aggregate and a join, which would move all rows twice
    told = {"n": F.count("*"), "lo": F.min("node"), "hi": F.max("node"), "x": F.bit_xor(F.xxhash64("t"))}
    placed = texts.select("t", "node", F.explode(keys).alias("b")).select("*", *(f.over(bucket).alias(k) for k, f in told.items())).where("lo < hi")
    placed = checkpoint(placed)
    buckets = placed.groupBy("n", "lo", "hi", "x").agg(F.min("b").alias("b")).select("b", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    shared = placed.select("t", "node", "b").join(buckets, "b").withColumn("part", F.pmod(F.xxhash64("t", F.lit(1)), F.col("parts")).cast("int"))
    shared = checkpoint(shared)  # so that the join has exchanges of its own, which can be split
    members = shared.join(texts.select("t", "node", "signature"), ["t", "node"])
    listed = members.groupBy("b", "parts", "part").agg(F.collect_list(F.struct("node", "signature")).alias("m"))
    large = checkpoint(listed.where("parts > 1").select("b", "part", "m"))
    met = large.groupBy("b").agg(F.min(F.struct("part", F.get("m", F.lit(0)).alias("one"))).alias("met")).select("b", "met.one")
    every = listed.where("parts = 1").select("m").union(large.join(met, "b").select(F.concat("m", F.array("one"))))
    found = _linked(every.withColumn("cut", F.size("m")), least)
    if large.isEmpty():
        return found
    joined = checkpoint(found)
    return joined.union(_linked(crossed(large, components(joined), crowd), least)).distinct()


def crossed(large: DataFrame, joined: DataFrame, crowd: int) -> DataFrame:
    """Rows (m, cut) for what is yet to compare in large(b, part, m), with joined(node, root) known.

    Of a pair that isn't joined, one is outside the bucket's largest component. So those
    outside, in parts of `crowd`, meet all parts of the bucket: a bucket of copies of one
    text takes rows linear in its members, however many they are, and only texts that
    resemble nothing take the square of their number.
    """
    each = large.select("b", "part", F.inline("m")).join(joined, "node", "left").select("b", "part", F.coalesce("root", "node").alias("node"), "signature")
    each = checkpoint(each.dropDuplicates(["b", "node", "signature"]))
    sizes = each.groupBy("b", "node").agg(F.count("*").alias("n"))
    most = sizes.groupBy("b").agg(F.max(F.struct("n", "node")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
    split = checkpoint(each.join(most.select("b", F.col("most.node").alias("major"), F.ceil((F.col("n") - F.col("most.n")) / crowd).cast("int").alias("deals")), "b"))
    one = F.collect_list(F.struct("node", "signature"))
    outside = split.where("node <> major").withColumn("deal", F.pmod(F.xxhash64("node", "signature"), F.col("deals")).cast("int"))
    outside = outside.groupBy("b", "deal").agg(one.alias("m"))
    whole = split.groupBy("b", "part", "deals").agg(one.alias("m2")).select("b", "part", "m2", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    return outside.join(whole, ["b", "deal"]).repartition("b", "deal", "part").select(F.concat("m", "m2").alias("m"), F.size("m").alias("cut"))


def _ranked(keys: list[str]) -> Column:
    """A struct whose order puts nulls of the first key last."""
    return F.struct(F.col(keys[0]).isNull().alias("none"), *(F.col(k) for k in keys))


def drop_near_duplicates(docs: DataFrame, n: int = SKETCHES, least: float = LEAST) -> DataFrame:
    """One row of each group of near duplicates: the one of the smallest doc_id, then of the smallest content hash.

    First come the components of fingerprints within the radius. Then all distinct texts
    are placed in the tables of n sketches, and the components of all pairs that meet
    there and whose estimated similarity is at least `least` are joined too. All columns
    come back as they were. Rows equal in every column count as one.
    """
    keyed, keys = content_keyed(docs), ["id", "h1", "h2"]
    rows = checkpoint(fingerprints(keyed.select(*keys, "text"), keys, more=n))
    folded = checkpoint(rows.groupBy("fp").agg(F.min(_ranked(keys)).alias("first")))
    rooted = checkpoint(_rooted(folded, components(links(folded.select("fp")))))
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    if n:
        groups = checkpoint(groups)
        texts = rows.select("fp", F.xxhash64("fp", "sketches", "signature").alias("t"), "sketches", "signature")
        texts = texts.groupBy("fp", "t").agg(F.first("sketches").alias("sketches"), F.first("signature").alias("signature"))
        texts = checkpoint(texts.join(rooted.select("fp", F.col("root").alias("node")), "fp").drop("fp"))
        groups = _rooted(groups.withColumnRenamed("root", "fp"), components(similar(texts, least=least))).groupBy("root").agg(F.min("first").alias("first"))
    return keyed.join(groups.select("first.h1", "first.h2"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")
