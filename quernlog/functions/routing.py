"""Key hashing and hash routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_binary(key: Column) -> Column:
    return key.cast("binary")


def key_hash(key: Column) -> Column:
    """SHA-256 of the key's bytes, in hexadecimal."""
    return F.sha2(as_binary(key), 256)


def partition_of(key: Column, n: int) -> Column:
    """The key's shard: its hash's first two bytes, least significant first, modulo ``n``."""
    if not 1 <= n <= 65535:
        raise ValueError("the number of partitions must be between 1 and 65535")
    h = key_hash(key)
    return (F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int") % F.lit(n)).cast("int")


def literal_partition(key: bytes, n: int) -> int:
    """The same for a key at hand, so that a lookup can name its partition and prune all others."""
    import hashlib

    return int.from_bytes(hashlib.sha256(key).digest()[:2], "little") % n
