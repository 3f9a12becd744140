"""Reproducible per-row randomness.

``rand(seed)`` depends on how rows fall into partitions; these draw from a
hash of the row's own key instead, so results do not change with the
partition count and any engine with ``md5`` can restate them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def hash_key(*cols, seed: int = 0) -> Column:
    """52-bit non-negative integer from ``md5('c1|c2|…|seed')``."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    h = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")


def unit_hash(*cols, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from ``hash_key`` (exact: 52 bits / 2^52)."""
    return hash_key(*cols, seed=seed) / F.lit(TWO_52)


def hash_key_sql(cols: list[str], seed: int = 0) -> str:
    """The same key in DuckDB SQL."""
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5({parts} || '|{seed}'), 1, 13) AS BIGINT)"


def unit_hash_sql(cols: list[str], seed: int = 0) -> str:
    return f"({hash_key_sql(cols, seed)} / CAST({TWO_52!r} AS DOUBLE))"


def fingerprint(key, version: int = 1, rate: int = 1, size: tuple[int, int] = (224, 224),
                multi_view: bool = False, skip_video: bool = False) -> Column:
    """md5 of ``v<version>|<key>|rate=<r>|size=(w, h)|multi_view=<b>|skip_video=<b>``.

    Any change of a flag gives a different fingerprint (cache identity).
    """
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(f"v{version}"), k.cast("string"), F.lit(f"rate={rate}"),
                             F.lit(f"size={tuple(size)}"), F.lit(f"multi_view={multi_view}"),
                             F.lit(f"skip_video={skip_video}")))
