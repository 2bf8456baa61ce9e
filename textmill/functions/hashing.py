"""Deterministic pseudo-random draws from row keys.

A draw depends on the key and the seed only, so samples and splits do not change with the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def hash32(key: Column, seed: int | str) -> Column:
    """First 32 bits of md5("<seed>:<key>") as a long in [0, 2^32)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash52(key: Column, seed: int | str) -> Column:
    """First 52 bits of md5("<seed>:<key>")."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def hash_bucket(key: Column, buckets: int, seed: int | str) -> Column:
    return F.pmod(hash32(key, seed), F.lit(buckets))


def hash_unit(key: Column, seed: int | str) -> Column:
    """Draw in [0, 1)."""
    return hash32(key, seed) / F.lit(float(HASH_RANGE))
