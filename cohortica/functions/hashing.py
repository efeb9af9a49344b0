"""Deterministic draws: every random number is a hash of (seed, key parts).

The same key gives the same draw on every executor and every retry, so a lost
task recomputes to the same rows. md5 is used because other engines have it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 12
_RANGE = float(2 ** (4 * _HEX_DIGITS))


def hash_hex(seed: int, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_int(seed: int, *parts: Column | str) -> Column:
    """A non-negative 48-bit integer."""
    prefix = F.substring(hash_hex(seed, *parts), 1, _HEX_DIGITS)
    return F.conv(prefix, 16, 10).cast("long")


def hash_uniform(seed: int, *parts: Column | str) -> Column:
    """A double in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(_RANGE)


def entity_bucket(entity: Column | str, buckets: int) -> Column:
    """First eight hex digits of SHA-256 of the id, modulo ``buckets``."""
    c = F.col(entity) if isinstance(entity, str) else entity
    digest = F.sha2(c.cast("string"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))
