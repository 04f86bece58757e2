"""Partitions of up to 64 reads as bit masks: bit j says whether read j is of haplotype 1."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 64


def accept_mask(depth: Column) -> Column:
    """Ones for the lowest `depth` bits."""
    return F.when(depth >= MAX_DEPTH, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), depth.cast("int"))))


def bit(mask: Column, index: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, index.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def invert(mask: Column, depth: Column) -> Column:
    return F.bitwise_not(mask).bitwiseAND(accept_mask(depth))


def flip(mask: Column, index: Column) -> Column:
    return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int")))


def joined(high: Column, low: Column, low_depth: Column) -> Column:
    """The partition of two read lists put together, the low one's bits first."""
    return F.when(low_depth >= MAX_DEPTH, low).otherwise(F.call_function("shiftleft", high, low_depth.cast("int")).bitwiseOR(low))


def weight(mask: Column) -> Column:
    return F.bit_count(mask)


def text(mask: Column) -> Column:
    return F.lpad(F.bin(mask), MAX_DEPTH, "0")
