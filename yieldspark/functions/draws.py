"""Random draws by key: the same for the same seed and key, however rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str, nth: int = 0) -> Column:
    """In [0, 1): 13 hex digits of md5(seed|key) over 16**13; nth is 0 or 1. A null key counts as empty."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 13 * nth + 1, 13), 16, 10).cast("double") / 2.0**52


def normal(key: Column, seed: int | str) -> Column:
    """Standard normal, of the key's two uniform draws (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed, 1))


def uniform_sql(key: str, seed: int | str, nth: int = 0) -> str:
    """The same draw as DuckDB SQL."""
    return f"(('0x' || substr(md5('{seed}|' || coalesce({key}::VARCHAR, '')), {13 * nth + 1}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
