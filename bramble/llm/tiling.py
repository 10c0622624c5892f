"""Benchmark decontamination by greedy string tiling.

Words are compared lower-cased and without punctuation at either end, by 64-bit hashes.
A document and a benchmark item meet in a join on shared seeds of five words (a
shorter item: all its words). Every tile consists of shared seeds, so the words of the
item that shared seeds cover bound the tiles from above; pairs below the threshold by
that bound go no further. The others are tiled: again and again the longest runs of
words that are equal and not yet marked in either text become tiles, those that begin
earliest in the item, then in the document, first, until no run of a seed's length is
left. The longest length is found by halving, with running Karp-Rabin hashes of the
windows of a length; periodic texts cost no more than others. Tiles may stand in any
order, so reordered passages count. A document is contaminated if tiles cover at least
`threshold` of some item's words.

The documents are read once: a Bloom filter of the benchmark's seeds, of a size that
the number of seeds sets, lets a task name only seeds that the benchmark is likely to
hold, and only the words around them go on. Beyond its largest size the filter lets
more through, and the join still decides. Neither the benchmark nor whole documents
reach the driver or are broadcast. Rows of the same text and doc_id are judged once.

Null or empty documents are clean with coverage zero; so are documents of which no
item passes the bound. Items without words match nothing, equal items of one id count
once, and equal coverages go to the smallest item id, null last. An item of fewer than
`shortest` words has no say, since common phrases would match it. Texts of any length
are judged whole, in time proportional to their length. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import WORD, checkpoint, sliced, text_of

SEED_WORDS, THRESHOLD, SHORTEST = 5, 0.8, 3
#: Bits of the filter for each seed, probes, and the largest filter: 2**28 bits, 32 MB.
FILTER_BITS, PROBES, MOST_BITS = 32, 4, 28
_BASE = 0x9E3779B97F4A7C15
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WORDS = re.compile(WORD)


def words(text: str) -> list[str]:
    """The compared form of the words; a word of punctuation only is dropped."""
    found = (w if w.isalnum() else _EDGES.sub("", w) for w in _WORDS.findall(text.lower()))
    return [w for w in found if w]


def hashed(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    found = words(text)
    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in dict.fromkeys(found)}
    return np.fromiter((known[w] for w in found), dtype=np.uint64, count=len(found))


def _finished(h: np.ndarray) -> np.ndarray:
    """Bits of a running hash mixed through, so that any of them can be taken."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """The running Karp-Rabin hash, modulo 2**64, of each window of `size` tokens, finished.

    The window of `size` is put together from windows of powers of two, each from two
    halves, so all windows cost one pass for each bit of the size.
    """
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, at, part, power, step = np.zeros(n, dtype=np.uint64), 0, _finished(tokens), _BASE, 1
    while True:
        if size & step:
            out = out * np.uint64(power) + part[at : at + n]
            at += step
        if 2 * step > size:
            return _finished(out)
        part, power, step = part[:-step] * np.uint64(power) + part[step:], power * power % (1 << 64), 2 * step


def _open_windows(hashes: np.ndarray, free: np.ndarray, size: int) -> np.ndarray:
    """The starts of the windows all of whose tokens are free."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[: len(hashes)]) if len(hashes) else np.empty(0, dtype=np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length). Zeros in doc match nothing."""
    if least > min(len(doc), len(item)):
        return []
    free_d, free_i, found = doc != 0, np.ones(len(item), dtype=bool), []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the open windows of either text that the other has too."""
        hi, hd = windows(item, size), windows(doc, size)
        p, q = _open_windows(hi, free_i, size), _open_windows(hd, free_d, size)
        p = p[np.isin(hi[p], hd[q])]
        q = q[np.isin(hd[q], hi[p])]
        return p, hi[p], q, hd[q]

    most = len(item)
    while True:
        low, high, best = least, min(most, len(doc)), None
        while low <= high:  # a run of a length holds runs of all lesser ones
            size = (low + high) // 2 if best else low  # first whether there is any
            now = shared(size)
            if len(now[0]):
                low, best = size + 1, (size, now)
            elif best is None:
                return found
            else:
                high = size - 1
        if best is None:
            return found
        size, (p, hp, q, hq) = best
        order = np.argsort(hq, kind="stable")
        hq, q = hq[order].tolist(), q[order].tolist()
        first = {h: at for at, h in reversed(list(enumerate(hq)))}
        before = len(found)
        for start, h in zip(p.tolist(), hp.tolist(), strict=True):
            at = first[h]
            while free_i[start : start + size].all() and at < len(q) and hq[at] == h:
                to = q[at]
                at += 1  # what is marked stays so, and what is marked now is
                if free_d[to : to + size].all() and (doc[to : to + size] == item[start : start + size]).all():
                    free_i[start : start + size] = free_d[to : to + size] = False
                    found.append((start, to, size))
            first[h] = at
        most = size if len(found) > before else size - 1  # less one only after an equal hash of unequal runs


def _key(columns: list[str]) -> list[Column]:
    said = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2")]


def items_of(benchmark: DataFrame, seed: int = SEED_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """item_id, k (a number of the item), n (its words), width, tokens and seeds of every distinct item with words enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"keep": [], "n": [], "width": [], "tokens": [], "seeds": []}
            for at, text in enumerate(b.column(1).to_pylist()):
                tokens = hashed(text)
                if len(tokens) >= max(1, shortest):
                    width = min(seed, len(tokens))
                    for name, x in zip(rows, (at, len(tokens), width, tokens.view(np.int64).tolist(), windows(tokens, width).view(np.int64).tolist()), strict=True):
                        rows[name].append(x)
            keep = pa.array(rows.pop("keep"), pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), *(pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True))], ["item_id", *rows])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = benchmark.select("item_id", text_of().alias("text")).distinct().mapInArrow(run, f"item_id {kind}, n int, width int, tokens array<bigint>, seeds array<bigint>")
    return checkpoint(found.withColumn("k", F.xxhash64(F.col("item_id").isNull(), "item_id", "tokens")))


def _probes(seeds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (seeds + np.uint64(k) * (seeds >> np.uint64(32) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def filter_of(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of all seeds, in words of 64 bits, and the widths that occur. The tasks put its words together."""
    told = items.agg(F.sum(F.size("seeds")), F.collect_set("width")).first()
    bits = min(MOST_BITS, max(16, ((told[0] or 1) * FILTER_BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = np.unique(b.column(0).to_numpy().view(np.uint64))
            spots = np.unique(np.concatenate(list(_probes(seeds, bits)))) if len(seeds) else seeds
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (spots & np.uint64(63))).view(np.int64))], ["at", "bit"])

    set_ = items.select(F.explode("seeds").alias("s")).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("v"))
    made = np.zeros(1 << bits >> 6, dtype=np.uint64)
    rows = set_.toPandas()  # at most a row for each of the filter's words
    made[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(np.uint64)
    return made, sorted(told[1] or [])


def _cut(tokens: np.ndarray, starts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The tokens of the windows (width, starts), those that touch or overlap together, zeros between others."""
    inside = np.zeros(len(tokens) + 1, dtype=np.int64)
    for width, at in starts:
        np.add.at(inside, at, 1)
        np.add.at(inside, at + width, -1)
    held = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(held) > 1) + 1
    return np.insert(tokens[held], gaps, np.uint64(0))


def excerpts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (the row's key), and of documents with words of a likely seed: seeds, and part, the words of the windows."""
    made, widths = filter_of(items)
    sent = docs.sparkSession.sparkContext.broadcast(made)
    bits = (len(made) * 64).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        for b in sliced(batches):
            seeds, parts = [], []
            for text in b.column(3).to_pylist():
                tokens, found, starts = hashed(text), [], []
                for width in widths:
                    h = windows(tokens, width)
                    hit = np.arange(len(h))
                    for spots in _probes(h, bits):  # nearly all windows fall out at the first probe
                        spots = spots[hit]
                        hit = hit[(filter_[spots >> np.uint64(6)] >> (spots & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    if len(hit):
                        found.append(h[hit])
                        starts.append((width, hit))
                seeds.append(np.unique(np.concatenate(found)).view(np.int64).tolist() if found else None)
                parts.append(_cut(tokens, starts).view(np.int64).tolist() if found else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seeds, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "seeds", "part"])

    rows = docs.select("doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", *_key(["doc_id", "text"]), "text").mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, seeds array<bigint>, part array<bigint>")


def pairs(found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """h1, h2, k: the documents and items whose shared seeds cover at least the threshold of the item's words."""
    ours = found.select("h1", "h2", F.explode("seeds").alias("seed"))
    theirs = items.select("k", "n", "width", F.posexplode("seeds").alias("p", "seed")).groupBy("seed", "k", "n", "width").agg(F.collect_list("p").alias("ps"))
    met = ours.join(theirs, "seed").groupBy("h1", "h2", "k", "n", "width").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("ps"))
    # windows in order: each covers what the next one leaves it
    covered = F.aggregate(F.transform("ps", lambda p, i: F.least(F.col("width"), F.coalesce(F.get("ps", i + 1) - p, F.col("width")))), F.lit(0), lambda s, x: s + x)
    return met.where(covered >= threshold * F.col("n")).select("h1", "h2", "k")


def verdicts(found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """h1, h2, coverage, item_id and n_tiles, by the item of the largest coverage, of documents with a pair."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coverage, count = [], []
            for k in range(b.num_rows):
                doc, item = (b.column(c)[k].values.to_numpy().view(np.uint64) for c in (2, 3))
                least = b.column(4)[k].as_py()
                h = windows(doc, least)
                near = _cut(doc, [(least, np.flatnonzero(np.isin(h, windows(item, least))))]) if len(h) else doc[:0]
                made = tiles(near, item, least)
                coverage.append(sum(n for *_, n in made) / len(item))
                count.append(len(made))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), pa.array(coverage, pa.float64()), pa.array(count, pa.int64())], ["h1", "h2", "item_id", "coverage", "n_tiles"])

    once = found.groupBy("h1", "h2").agg(F.first("part").alias("part"))
    # the join of the parts has exchanges of its own, so that one item's many documents can be split
    joined = checkpoint(pairs(found, items, threshold)).join(once, ["h1", "h2"]).join(items.select("k", "tokens", "width", "item_id"), "k")
    tiled = joined.select("h1", "h2", "part", "tokens", "width", "item_id").mapInArrow(run, f"h1 long, h2 long, item_id {kind}, coverage double, n_tiles long")
    best = F.min(F.struct((-F.col("coverage")).alias("less"), F.col("item_id").isNull().alias("none"), "item_id", "n_tiles")).alias("b")
    return tiled.groupBy("h1", "h2").agg(best).select("h1", "h2", (-F.col("b.less")).alias("coverage"), "b.item_id", "b.n_tiles")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, contaminated, coverage, item_id and n_tiles of every document; item_id is null, and the rest 0, where no item passes the seeds' bound."""
    items = items_of(benchmark, seed, shortest)
    rows = checkpoint(excerpts(docs, items))
    found = rows.where("part is not null")
    judged = verdicts(found, items, threshold)
    clean = rows.where("part is null").select("doc_id", F.lit(None).cast("double").alias("coverage"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("long").alias("n_tiles"))
    out = found.select("doc_id", "h1", "h2").join(judged, ["h1", "h2"], "left").select("doc_id", "coverage", "item_id", "n_tiles").union(clean)
    coverage = F.coalesce("coverage", F.lit(0.0))
    return out.select("doc_id", (coverage >= threshold).alias("contaminated"), coverage.alias("coverage"), "item_id", F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The documents that no item is found in, all columns as they were."""
    items = items_of(benchmark, seed, shortest)
    found = checkpoint(excerpts(docs, items).where("part is not null"))
    bad = verdicts(found, items, threshold).where(F.col("coverage") >= threshold).select("h1", "h2")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", text_of().alias("text")).select("row", *_key(["doc_id", "text"]))
    return keyed.join(checkpoint(bad), ["h1", "h2"], "left_anti").select("row.*")
