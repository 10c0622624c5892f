"""String functions over names and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(name: Column) -> Column:
    """A-Z to lower case; other letters stay."""
    return F.translate(name, _UPPER, _LOWER)


def prefix_of(name: Column, length: int | Column) -> Column:
    """The first characters; shorter names pass whole."""
    return F.substring(name, F.lit(1), length if isinstance(length, Column) else F.lit(length))


def all_prefixes(name: Column, longest: int) -> Column:
    """The prefixes of 1 to `longest` characters, as an array."""
    last = F.least(F.length(name), F.lit(longest))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda n: F.substring(name, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def successor_of(prefix: Column) -> Column:
    """The least byte string above all that begin with the prefix, in hexadecimal; empty for an empty prefix.

    UTF-8 has no byte 0xff, so the last byte can always be raised.
    """
    code = F.hex(F.encode(prefix, "UTF-8"))
    last = F.conv(F.right(code, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(F.length(prefix) == 0, F.lit("")).otherwise(F.concat(F.substring(code, F.lit(1), F.length(code) - 2), F.lpad(F.hex(last), 2, "0")))


def is_ascii(name: Column) -> Column:
    return ~name.rlike(r"[^\x00-\x7F]")


def binary_name(n: Column, width: int, zero: str = ".", one: str = ":") -> Column:
    """A test name: the number in binary with two signs for the digits."""
    return F.translate(F.lpad(F.bin(n), width, "0"), "01", zero + one)
