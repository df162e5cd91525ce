"""Packed fields, hexadecimal text, identifiers and other text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_hex(value: Column, width: int = 8) -> Column:
    """Upper-case hexadecimal of the lowest `4 * width` bits."""
    return F.right(F.lpad(F.hex(value), width, "0"), F.lit(width))


def from_hex(text: Column) -> Column:
    """Unsigned number of up to 64 bits; NULL where the text is no hexadecimal number."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(text, 16, 10).cast("decimal(20,0)"))


def bits(value: Column, low: int, n: int) -> Column:
    """n bits from bit `low` on."""
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << n) - 1)


def action_type(packed: Column) -> Column:
    return bits(packed, 24, 8)


def action_id(packed: Column) -> Column:
    return bits(packed, 0, 24)


def identifier(text: Column) -> Column:
    """Words in title case, joined; apostrophes vanish, all else that is no letter or digit separates."""
    words = F.initcap(F.regexp_replace(F.lower(F.translate(text, "'", "")), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, " ", "")


def number_after(text: Column, word: str) -> Column:
    """The first whole number behind a word, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, rf"{word}\D{{0,3}}(\d{{1,9}})", 1), F.lit("")).try_cast("int")


def rotated(array: Column, by: Column) -> Column:
    """The array turned left by `by` places."""
    n = F.size(array)
    k = F.when(n > 0, F.pmod(by, n)).otherwise(0)
    return F.concat(F.slice(array, k + 1, n), F.slice(array, F.lit(1), k))


def changed(before: Column, after: Column) -> Column:
    """(index, value) of what differs between two arrays."""
    pairs = F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    return F.transform(F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])), lambda p: F.struct(p["i"].alias("i"), p["b"].alias("value")))


def compacted(array: Column) -> Column:
    """(index, value) of what is not zero."""
    return F.filter(F.transform(array, lambda v, i: F.struct(i.alias("i"), v.alias("value"))), lambda p: p["value"] != 0)


def damage(value: Column, high: Column, flags: Column) -> Column:
    """A value whose third byte sits in another field, where a flag says so."""
    return value + F.when(flags.bitwiseAND(0x40) != 0, high * 65536).otherwise(0)


def dequantise(q: Column, low: float, high: float, steps: int = 65535) -> Column:
    """A coordinate from its share of a range in whole steps."""
    return q * (high - low) / steps + low
