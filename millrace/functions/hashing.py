"""Deterministic hashes and ranks; each has an equal in ANSI SQL engines with md5 and sha256."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_hash(salt: Column | str, key: Column | str) -> Column:
    """The first 32 bits of md5('salt|key') as a bigint."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|") if isinstance(salt, str) else F.concat(salt, F.lit("|")), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash_rank(*parts: Column | str) -> Column:
    """sha256 over the parts joined by '|', in hex: the order of a deterministic draw."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def key_hash(key: Column | str) -> Column:
    return F.sha2(F.col(key) if isinstance(key, str) else key, 256)
