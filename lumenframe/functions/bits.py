"""Words of the raw stream: code and payload, status bits, signed fixed point, checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the status bits, from the lowest.
STATUS = ("scanning", "tracking", "out_of_range", "stim", "gated", "locked", "valid")


def word_code(w: Column) -> Column:
    return F.shiftright(w, 12).bitwiseAND(15)


def word_payload(w: Column) -> Column:
    return w.bitwiseAND(4095)


def signed16(w: Column, scale: float = 64.0) -> Column:
    """A 16-bit two's complement word over its scale."""
    return F.when(w >= 32768, w - 65536).otherwise(w) / scale


def status_bits(s: Column) -> dict[str, Column]:
    return {name: s.bitwiseAND(1 << i) != 0 for i, name in enumerate(STATUS)}


def checksum(words: list[Column]) -> Column:
    """0 for a record whose words agree with their checksum."""
    return reduce(lambda a, b: a.bitwiseXOR(b), words)
