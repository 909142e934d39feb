"""Key groups and expiry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PARALLELISM = 128


def key_group(key: Column, groups: int = MAX_PARALLELISM, hashed: bool = True) -> Column:
    """The key group of a key; all namespaces of a key are in its group. Integer keys can be taken as they are."""
    return F.pmod(F.xxhash64(key) if hashed else key, F.lit(groups)).cast("int")


def group_range(index: int, parts: int, groups: int = MAX_PARALLELISM) -> tuple[int, int]:
    """First and last key group of part ``index`` of ``parts``; the parts cover all groups and don't overlap."""
    return -(-index * groups // parts), -(-(index + 1) * groups // parts) - 1


def live(written: Column, ttl: Column | int, now: Column) -> Column:
    """Whether a value written at ``written`` (milliseconds) is not expired: at written + ttl it is. A ttl of 0 never expires."""
    ttl = F.lit(ttl) if isinstance(ttl, int) else ttl
    return (ttl <= 0) | (written + ttl > now)


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp, read as UTC if it has no zone."""
    return F.unix_millis(ts.cast("timestamp"))
