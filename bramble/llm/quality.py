"""Quality rules: counts of words and repeats, and distribution divergence.

The base rules fail texts of fewer than 50 words, or more than half of whose words lie
in three-word windows that occur twice or more in the text. The method compares two
histograms of each remaining text, of its character classes and of very common words
of its language, standing alone and in lower case, with the language's references by the Jensen-Shannon distance (base
2, from 0 to 1). A reference is the mean of the histograms of all texts of that
language that are long enough. Distances have minimum-length guards: texts shorter
than that are not judged by them. Languages without a word list, and null ones, are
judged by characters alone, each against its own reference.

All steps are DataFrame operations. Texts stay in their rows; only histograms are
shuffled, summed by language in partial sums first. Windows are compared by 64-bit
hashes within one text. Null texts count as empty; repeated rows and ids each have their
row and weigh in the references as often; other columns are ignored. Texts of any length
are judged whole. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import WORD, checkpoint, let, text_of

LEAST_WORDS, MOST_REPEATED = 50, 50
#: The least words for a verdict by distances, and the distances beyond which a text is not kept.
GUARD, MOST_CHARS, MOST_WORDS = 80, 0.25, 0.30
#: Very common words of each language, sixteen each.
COMMON = {
    "en": "the of and to in a is that it was for on are as with be".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
#: Character classes, white space first; what is left makes the last one.
CLASSES = (r"[\x20\x09-\x0D]+", "[a-z]+", "[A-Z]+", "[0-9]+", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


def repeated_words(words: Column) -> Column:
    """The number of words in three-word windows found twice or more."""
    last = F.size(words) - 3

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        # of sorted windows, those equal to the one before or after
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))  # most texts repeat nothing

    return F.when(last < 1, F.lit(0)).otherwise(let(hashed(words), counted)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """The number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, and the two histograms of every text."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    every = sorted({w for list_ in COMMON.values() for w in list_})

    def of_words(w: Column) -> Column:
        # every common word between two spaces of its own, so that one's removal leaves the others alone
        found = F.array_join(F.filter(w, lambda x: x.isin(*every)), "  ")
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.concat(F.lit(" "), found, F.lit(" ")).alias("found"))

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    rows = rows.select("doc_id", "lang", let(words, of_words).alias("c"), duplicate_lines(text).alias("n_dup_lines"), F.length(text).alias("left0"), F.regexp_replace(text, CLASSES[0], "").alias("rest"))
    # each class is taken out of what the ones before have left
    for k, c in enumerate(CLASSES[1:], 1):
        if k == 2:  # symbols are neither white space nor letters
            rows = rows.withColumn("n_symbols", (F.length("rest") - F.length(F.translate("rest", "#*$%&|<>", ""))).cast("long"))
        rows = rows.withColumn(f"left{k}", F.length("rest")).withColumn("rest", F.regexp_replace("rest", c, ""))
    last = len(CLASSES)
    rows = rows.withColumn(f"left{last}", F.length("rest")).drop("rest")
    classes = F.array(*(F.col(f"left{k}") - F.col(f"left{k + 1}") for k in range(last)), F.col(f"left{last}"))

    def tally(word: str) -> Column:
        gone = F.octet_length("c.found") - F.octet_length(F.replace(F.col("c.found"), F.lit(f" {word} "), F.lit("")))
        return (gone / (len(word.encode()) + 2)).cast("int")

    common = F.lit(None).cast("array<int>")
    for lang, list_ in COMMON.items():
        common = F.when(F.col("lang") == lang, F.array(*map(tally, list_))).otherwise(common)
    return rows.select("doc_id", "lang", "c.n_words", "c.n_repeat_words", F.col("left1").cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", classes.alias("classes"), common.alias("common"))


def _distance(p: list[Column], q: list[Column]) -> Column:
    """The Jensen-Shannon distance of two histograms given by their shares."""
    half = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    total = sum((part(x, m) + part(y, m) for x, y, m in zip(p, q, half, strict=True)), F.lit(0.0)) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _histograms() -> tuple[list[Column], list[Column]]:
    """Shares of each character class in all characters, and of each common word, and the rest, in all words."""
    chars = F.greatest(F.aggregate("classes", F.lit(0), lambda s, x: s + x), F.lit(1))
    a = [F.get("classes", F.lit(i)) / chars for i in range(len(CLASSES) + 1)]
    n = F.greatest(F.col("n_words"), F.lit(1))
    b = [F.least(F.coalesce(F.get("common", F.lit(i)), F.lit(0)) / n, F.lit(1.0)) for i in range(16)]
    return a, [*b, F.greatest(1 - sum(b[1:], b[0]), F.lit(0.0))]


def judge(docs: DataFrame, guard: int = GUARD, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Counts, distances and verdicts of every text."""
    rows = checkpoint(features(docs))
    a, b = _histograms()
    long = F.col("n_words") >= guard
    shares = rows.where(long).groupBy("lang").agg(*(F.avg(x).alias(f"a{i}") for i, x in enumerate(a)), *(F.avg(x).alias(f"b{i}") for i, x in enumerate(b))).withColumnRenamed("lang", "l2")
    shares = checkpoint(shares)
    few = shares.limit(1001).count() <= 1000
    joined = rows.join(F.broadcast(shares) if few else shares, F.col("lang").eqNullSafe(F.col("l2")), "left")
    by_chars = F.when(long, _distance(a, [F.col(f"a{i}") for i in range(len(a))]))
    by_words = F.when(long & F.col("common").isNotNull(), _distance(b, [F.col(f"b{i}") for i in range(len(b))]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    apart = F.coalesce(by_chars > most_chars, F.lit(False)) | F.coalesce(by_words > most_words, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~apart).alias("kept"), by_chars.alias("char_distance"), by_words.alias("word_distance"))
