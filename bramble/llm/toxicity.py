"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word stems is learned from labelled texts, then fourteen
features of each whole text: densities of lexicon hits, how many stand near a
second-person word, capitals, punctuation, exclamation and obfuscation rates, and
length. Lexicon and trees come from three quarters of the training rows;
pool-adjacent-violators on the others, which neither has seen, turns margins into
probabilities. Scores see the text only.

Training takes at most `most` labelled doc_ids, those of the smallest hashes, and one
text of each (the one of the smallest hash, where an id repeats), so that many rows at
most; with fewer labels it takes all. The lexicon holds every term that passes the
test, and since each occurs in at least four toxic texts of that sample, the sample
bounds it. Null and empty texts have all features zero and get that score. Conflicting
labels of one doc_id count as toxic; labels that are null are left out. Without
labels of both kinds nothing tells texts apart, and all scores are near 0. Texts of any length
are read whole, in time proportional to their length; repeated rows get equal scores;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import checkpoint, sliced, text_of

#: Labelled rows that training takes at most.
MOST_ROWS = 20_000
#: Terms that a task counts before it passes its counts on.
MOST_HELD = 200_000
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split())
#: Signs that stand for letters in obfuscated words.
UNMASK = str.maketrans("013457@$!", "oieastasi")
STEMS = (4, 5, 6, 7)
NEAR = 5
_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[\d@$!*._-](?<=[^\W\d_].)[\d@$!*._-]*(?=[^\W\d_])")
_MASKED = re.compile(r"[\d@$!](?<=[^\W\d_].)(?=[^\W_])|[@$](?=[^\W\d_])")
_CAPITAL, _SIGNS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]+")
_SPACE = re.compile(r"\s")
_LONG = re.compile(r"([^\W_])\1\1\1+")
FEATURES = ("words", "hits", "distinct", "density", "strongest", "stem_hits", "stem_density", "near_second_person", "second_person", "capitals", "punctuation", "exclamations", "obfuscated", "long_repeats")


def tokens(text: str) -> list[str]:
    """Lower-case words; words that hide letters behind signs also appear with the letters back."""
    low = text.lower()
    out = _TOKEN.findall(low)
    end = 0
    for m in _MASKED.finditer(low):
        if m.start() >= end:  # its whole run of characters without white space
            start, last = m.start(), end
            while start > last and not low[start - 1].isspace():
                start -= 1
            space = _SPACE.search(low, m.end())
            end = space.start() if space else len(low)
            out.extend(_TOKEN.findall(low[start:end].rstrip("!?.,;:'\")").translate(UNMASK)))
    return out


def terms(found: set[str]) -> set[str]:
    """What the lexicon may hold of a text's words: each, and its stems of four to seven letters."""
    return found | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list = field(default_factory=list)
    knots: tuple = ((0.0,), (0.0,))

    def features(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        found = tokens(text)
        n = len(found) or 1
        lexicon, stems, sizes = self.lexicon, self.stems, sorted({len(s) for s in self.stems})
        count = Counter(found)
        hits = {w: k for w, k in count.items() if w in lexicon}
        stem_hits = Counter()
        if sizes:
            for w, k in count.items():
                for size in sizes:
                    if len(w) > size and w[:size] in stems:
                        stem_hits[w] = k
                        break
        marked = hits.keys() | stem_hits.keys()
        near = 0
        if marked and any(w in count for w in SECOND_PERSON):
            people = [i for i, w in enumerate(found) if w in SECOND_PERSON]
            spots = np.array([i for i, w in enumerate(found) if w in marked])
            after = np.searchsorted(people, spots)
            ends = np.array([-NEAR - 1 - len(found), *people, len(found) * 2 + NEAR + 1])
            near = int((np.minimum(spots - ends[after], ends[after + 1] - spots) <= NEAR).sum())
        letters = sum(map(len, found)) or 1
        total, total_stems = sum(hits.values()), sum(stem_hits.values())
        strongest = max([*(lexicon[w] for w in hits), *(max(stems.get(w[:s], 0.0) for s in sizes) for w in stem_hits)], default=0.0)
        return [
            float(np.log1p(n)), float(total), float(len(hits)), 100.0 * total / n, strongest, float(total_stems), 100.0 * total_stems / n,
            float(near), sum(count[w] for w in SECOND_PERSON) / n, len(_CAPITAL.findall(text)) / letters,
            sum(map(len, _SIGNS.findall(text))) / len(text), 100.0 * text.count("!") / len(text),
            len(_MIXED.findall(text)) / n, len(_LONG.findall(text)) / n,
        ]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree_values(tree, x)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a thousandth of the raw one so that ties on the isotonic steps keep the margin's order."""
        m = self.margins(x)
        return 0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m))


def tree_values(tree: list, x: np.ndarray) -> np.ndarray:
    """tree: (feature, threshold, left, right) or (value,) by node."""
    at = np.zeros(len(x), dtype=np.int64)
    feature = np.array([n[0] if len(n) == 4 else -1 for n in tree])
    cut = np.array([n[1] if len(n) == 4 else n[0] for n in tree])
    kids = np.array([n[2:] if len(n) == 4 else (0, 0) for n in tree])
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        at[rows] = kids[node, (x[rows, feature[node]] > cut[node]).astype(int)]
    return cut[at]


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, edges: list[np.ndarray], binned: np.ndarray, rate: float, ridge: float = 1.0, least: int = 5) -> list:
    """One regression tree on gradients g and curvatures h, by histograms of binned features."""
    tree: list = []

    def split(rows: np.ndarray, left: int) -> int:
        me = len(tree)
        tree.append(None)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if len(e) == 0:
                    continue
                b = binned[rows, f]
                n = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                gl = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(n < least) | (len(rows) - n < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, e[k]))
        if best[1] is None:
            tree[me] = (float(-rate * gs / (hs + ridge)),)
            return me
        f, cut = best[1]
        right = x[rows, f] > cut
        a = split(rows[~right], left - 1)
        b = split(rows[right], left - 1)
        tree[me] = (f, float(cut), a, b)
        return me

    split(np.arange(len(x)), depth)
    return tree


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48) -> tuple[float, list]:
    """Base margin and trees for the logistic loss."""
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    for f, c in enumerate(x.T):  # rare features: their few values beyond the quantiles
        extra = np.unique(c[c > edges[f].max()]) if len(edges[f]) else np.array([])
        if len(extra):
            edges[f] = np.unique(np.concatenate([edges[f], np.quantile(extra, np.linspace(0, 1, 17)[:-1])]))
        edges[f] = edges[f][edges[f] < c.max()]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    m, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-m))
        trees.append(grow(x, q - y, q * (1 - q), depth, edges, binned, rate))
        m += tree_values(trees[-1], x)
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple:
    """Knots of the increasing step fit, by pooling adjacent violators; values are shrunk a little to the base rate, to which one clean row is added, so that nothing known means not toxic."""
    p = y.sum() / (len(y) + 1)
    blocks: list[list[float]] = []
    keys, place, size = np.unique(margin, return_inverse=True, return_counts=True)
    for m, n, v in zip(keys.tolist(), size.tolist(), np.bincount(place, y).tolist(), strict=True):  # equal margins first
        blocks.append([v, float(n), m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    at, value = [], []
    for s, n, a, b in blocks:
        v = (s + 0.2 * p) / (n + 0.2)
        at += [a, b] if b > a else [a]
        value += [v, v] if b > a else [v]
    return tuple(at), tuple(np.maximum.accumulate(value))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, toxic of the bounded training sample, a row for each doc_id; rows with crc32(doc_id) mod 5 = 0 are held out."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded number of short rows, so its broadcast is bounded
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))


def weighed(counts: DataFrame, n: int, positive: int) -> DataFrame:
    """term and weight of the terms that stand in toxic texts far more often than chance has it. counts(term, a, n): toxic texts and texts with the term, of `positive` and n."""
    # a Gaussian score of the term's toxic documents against the base rate, with the continuity correction
    rate = float(positive) / n
    z = (F.col("a") - 0.5 - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    weight = F.log((F.col("a") + 0.5) * (1 - rate) / ((F.col("n") - F.col("a") + 0.5) * rate))
    return counts.where(F.col("a") >= 4).select("term", z.alias("z"), weight.alias("weight")).where("z > 5 and weight > 2.5").select("term", "weight")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    rows = checkpoint(training_rows(docs, labels, most).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))))
    share = {r.aside: r for r in rows.groupBy((F.col("part") == 0).alias("aside")).agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).collect()}
    n, positive = (sum(r[c] or 0 for r in share.values()) for c in ("n", "p"))
    if not n or not positive or positive == n:
        return Model(knots=((0.0,), (0.0,)))
    apart = len(share) == 2 and all(r.p >= 8 for r in share.values())  # else too few to set some aside
    learned = rows.where("part <> 0") if apart else rows
    if apart:
        n, positive = share[False]["n"], share[False].p

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()
        for b in sliced(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms({w for w in tokens(text) if len(w) > 2})
                seen.update(found)
                if toxic:
                    bad.update(found)
                if len(seen) > MOST_HELD:
                    yield tally(seen, bad)
                    seen, bad = Counter(), Counter()
        yield tally(seen, bad)

    def tally(seen: Counter, bad: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([bad[t] for t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "a", "n"])

    counts = learned.select("text", "toxic").mapInArrow(split, "term string, a long, n long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    lexicon, stems = {}, {}
    for r in weighed(counts, n, positive).collect():
        (stems if r.term.endswith("*") else lexicon)[r.term.rstrip("*")] = r.weight
    model = Model(lexicon, stems)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [model.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    order = F.xxhash64("doc_id").alias("o")
    sample = rows.select("doc_id", "text", "toxic").mapInArrow(describe, f"doc_id {kind}, toxic int, x array<double>").select("toxic", "x", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("part"), order).collect()
    sample.sort(key=lambda r: (r.o, r.toxic, r.x))
    x, y = np.array([r.x for r in sample]), np.array([r.toxic for r in sample], dtype=float)
    aside = np.array([apart and r.part == 0 for r in sample])
    model.base, model.trees = boost(x[~aside], y[~aside])
    rest = aside if apart else ~aside
    model.knots = isotonic(model.margins(x[rest]), y[rest])
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = np.array([model.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = np.array([model.features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.scores(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
