"""Bit masks: packed longs and binary strings, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, col


def pack_array(flags: D) -> Column:
    """array<boolean> of at most 64 flags as one long, flag i as bit i."""
    def weight(flag: Column, i: Column) -> Column:
        return F.when(flag, F.when(i == 63, F.lit(-(2**63))).otherwise(F.pow(F.lit(2.0), i).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(col(flags), weight), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def test(mask: D, i: D | int) -> Column:
    return F.getbit(col(mask), col(i)) == 1


def pack_rows(flag: D, index: D) -> Column:
    """Aggregate: the flags of a group's rows as one long, by index 0 to 62."""
    return F.bit_or(F.when(col(flag), F.expr(f"shiftleft(1L, cast({index} as int))") if isinstance(index, str) else F.pow(F.lit(2.0), index).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def differing(a: D, b: D) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def test_bytes(mask: D, i: D) -> Column:
    """Bit i of a binary mask, false beyond its end."""
    byte = F.conv(F.hex(F.substring(col(mask), F.floor(col(i) / 8).cast("int") + 1, F.lit(1))), 16, 10).try_cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), col(i) % 8).cast("int")) > 0, F.lit(False))
