"""Reproducible draws: uniforms on [0, 1) from hashes, which any engine repeats whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: str, *keys: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def index(seed: str, n: Column, *keys: Column | str) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * n)
