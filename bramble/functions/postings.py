"""Functions over posting lists: sorted arrays of distinct ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_geq(ids: Column, bound: Column) -> Column:
    """The first id of at least the bound, or null."""
    return F.get(F.filter(ids, lambda x: x >= bound), F.lit(0))


def between(ids: Column, low: Column, high: Column) -> Column:
    """The ids in [low, high)."""
    return F.filter(ids, lambda x: (x >= low) & (x < high))


def position(ids: Column, one: Column) -> Column:
    """The place of an id, from 0, or -1."""
    return F.array_position(ids, one) - 1


def merged(lists: Column, without: Column) -> Column:
    """The distinct ids of several lists in order, without one."""
    return F.array_sort(F.array_remove(F.array_distinct(F.flatten(lists)), without))


def gaps(ids: Column) -> Column:
    """Delta code: the first id, then each step less one."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1) - 1))


def from_gaps(code: Column) -> Column:
    """The ids of a delta code."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, g: Column) -> Column:
        one = s["last"] + g + 1
        return F.struct(one.alias("last"), F.concat(s["ids"], F.array(one)).alias("ids"))

    return F.aggregate(code, start, step, lambda s: s["ids"])


def monotone(values: Column) -> Column:
    """A strictly increasing code of any non-negative values: running sums of value + 1, less one; repeats are allowed."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<bigint>").alias("code"))

    def step(s: Column, x: Column) -> Column:
        one = s["last"] + x + 1
        return F.struct(one.alias("last"), F.concat(s["code"], F.array(one)).alias("code"))

    return F.aggregate(values, start, step, lambda s: s["code"])


def from_monotone(code: Column) -> Column:
    return gaps(code)


def elias_fano_bits(n: Column, universe: Column) -> Column:
    """Estimated bits of n increasing ids below the universe."""
    low = F.greatest(F.floor(F.log2(universe.cast("double") / n)), F.lit(0))
    return (n * low + 2 * n + 1).cast("long")


def varint_bytes(gap: Column) -> Column:
    """Bytes of one gap at seven bits a byte."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(gap < 1 << 7 * size, size).otherwise(out)
    return out.cast("long")


def fixed_bytes(n: Column) -> Column:
    """A count and n ids of eight bytes."""
    return (8 * (n + 1)).cast("long")


def interpolative_bits(n: Column, span: Column) -> Column:
    """Estimated bits of n ids coded by halving within a span: log2 of the number of ways, by Stirling's formula."""
    m = span.cast("double")
    rest = F.greatest(m - n, F.lit(0.0))
    part = lambda x: F.when(x > 0, x * F.log2(m / x)).otherwise(0.0)
    return F.floor(part(n.cast("double")) + part(rest) + 0.999999).cast("long")  # rounded up, but for what logarithms leave behind the comma


def single_bits(n: Column, universe: Column) -> Column:
    """Estimated bits of a list in the best of three forms: Elias-Fano, a bitmap of the universe, or nothing where all ids are in it."""
    return F.when(n == universe, F.lit(0)).otherwise(F.least(elias_fano_bits(n, universe), universe)).cast("long")


def optpfor_bits(over: list[Column], n: Column) -> Column:
    """Estimated bits of a block of n gaps, over[b] of which need more than b bits: a byte for the width, the widths' bits, and a byte and the whole gap for each that is wider, at the best width."""
    return (8 + F.least(*(n * b + x * 40 for b, x in enumerate(over)))).cast("long")


def little_endian(value: Column, size: int) -> Column:
    """A number's `size` bytes in hexadecimal, lowest first."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), "")


def varint(value: Column) -> Column:
    """A number's bytes in hexadecimal at seven bits a byte, lowest first, the high bit set on all but the last."""
    last = varint_bytes(value).cast("int") - 1

    def one(i: Column) -> Column:
        low = F.expr("1L") * F.call_function("shiftright", value, 7 * i).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(low + F.when(i < last, 128).otherwise(0)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), one), "")


def raw_sequence(ids: Column) -> Column:
    """The stored bytes of a list, in hexadecimal: the gaps, each as a varint."""
    return F.array_join(F.transform(gaps(ids), varint), "")


def pack(lists: Column) -> Column:
    """Byte strings in hexadecimal, put together, each behind the varint of its length."""
    return F.array_join(F.transform(lists, lambda x: F.concat(varint((F.length(x) / 2).cast("long")), x)), "")


def unpack(packed: Column, place: int) -> Column:
    """The byte string at a place, from 0, of what pack() put together."""

    def byte(at: Column) -> Column:
        return F.coalesce(F.conv(F.substring(packed, at, F.lit(2)), 16, 10).cast("long"), F.lit(0))

    def head(at: Column) -> tuple[Column, Column]:
        """The length that stands there and where its bytes begin; lengths have at most five bytes."""
        size, begin = F.lit(0).cast("long"), at
        for k in range(4, -1, -1):  # a byte from 128 on is followed by another
            mine = byte(at + 2 * k)
            size = mine.bitwiseAND(F.lit(127)) + F.when(mine >= 128, size * 128).otherwise(0)
            begin = F.when(mine >= 128, begin).otherwise(at + 2 * (k + 1)) if k < 4 else at + 10
        return size, begin

    start = F.struct(F.lit(1).alias("begin"), F.lit(0).alias("size"))

    def step(s: Column, _: Column) -> Column:
        size, begin = head(s["begin"] + 2 * s["size"])
        return F.struct(begin.cast("int").alias("begin"), size.cast("int").alias("size"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(place)), start, step, lambda s: F.substring(packed, s["begin"], 2 * s["size"]))
