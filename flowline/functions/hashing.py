"""FNV-1a, the hash that deals keys to workers (EXC-4)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Offset basis and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes as a long; null stays null, the empty string gives the offset basis.

    Bytes come from the hex form, so keys outside ASCII hash right, and no Python runs.
    """
    digits = F.hex(F.encode(key, "UTF-8"))
    size = F.length(digits) / 2
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(MASK))
    places = F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(key.isNotNull(), F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), step))
