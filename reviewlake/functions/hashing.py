"""FNV-1a hashes and fingerprints as native expressions over a string's UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of the two FNV-1a widths.
BASIS_32, PRIME_32 = 0x811C9DC5, 0x01000193
BASIS_64 = 0xCBF29CE484222325
SEPARATOR = "\u0001"


def bound(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it in its own lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def utf8_bytes(s: Column) -> Column:
    """array<bigint> of a string's bytes."""
    one_each = F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")  # a character for each byte
    return F.transform(F.split(one_each, ""), lambda c: F.ascii(c).cast("bigint"))


def _bytes_or_none(s: Column) -> Column:
    return bound(s, lambda x: F.when(F.length(x) > 0, utf8_bytes(x)).otherwise(F.array().cast("array<bigint>")))


def utf16_units(s: Column) -> Column:
    """array<bigint> of a string's UTF-16 code units: one for each character, two for those beyond U+FFFF."""
    unit = lambda digits: F.conv(digits, 16, 10).cast("bigint")
    return F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(....)"), F.lit(1)), unit)


def _fnv1a32(units: Column) -> Column:
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME_32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(BASIS_32).cast("bigint"), step)


def fnv1a32(s: Column) -> Column:
    """FNV-1a 32 of the bytes, as a non-negative bigint."""
    return _fnv1a32(_bytes_or_none(s))


def fnv1a32_utf16(s: Column) -> Column:
    """FNV-1a 32 that takes a string's UTF-16 code units whole, as stores written by scripts do."""
    return _fnv1a32(utf16_units(s))


def fnv1a64(s: Column) -> Column:
    """FNV-1a 64 of the bytes, as a bigint of the same bits.

    The 64-bit product is put together from two 32-bit halves: ANSI arithmetic may not overflow.
    """
    low = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        a = x.bitwiseAND(low) * F.lit(435)
        high = F.shiftrightunsigned(x, 32) * F.lit(435) + F.shiftrightunsigned(a, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high.bitwiseAND(low), 32).bitwiseOR(a.bitwiseAND(low))

    return F.aggregate(_bytes_or_none(s), F.lit(BASIS_64 - (1 << 64)).cast("bigint"), step)


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def fingerprint(*parts: Column) -> Column:
    """Sixteen hexadecimal digits for a tuple of strings."""
    return hex16(fnv1a64(F.concat_ws(SEPARATOR, *parts)))


def memory_id(kind: Column, text: Column) -> Column:
    """Name of a memory, over UTF-16 units: the same as in stores that scripts have written."""
    return F.concat(F.lit("m_"), F.lpad(F.lower(F.hex(fnv1a32_utf16(F.concat_ws("\u0000", kind, text)))), 8, "0"))
