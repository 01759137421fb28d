"""Repeatable randomness: every draw is a function of (seed, key, salt) only.

``rand(seed)`` depends on how rows fall into partitions, so a retried task or another
cluster size would change a sample. A hash of the row key does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def digest(seed, *parts) -> Column:
    return F.md5(F.concat_ws("|", *[_as_col(p).cast("string") for p in (seed, *parts)]).cast("binary"))


def u32(seed, *parts) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return u32(seed, *parts) / F.lit(float(U32))


def normal(seed, *parts) -> Column:
    """Standard normal by Box-Muller, both uniforms cut from one digest."""
    d = digest(seed, *parts)
    u = (F.conv(F.substring(d, 1, 8), 16, 10).cast("double") + 0.5) / float(U32)
    v = (F.conv(F.substring(d, 9, 8), 16, 10).cast("double") + 0.5) / float(U32)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def timestep_sample(timesteps: int, seed, *parts) -> Column:
    """Uniform integer in [0, timesteps)."""
    return F.pmod(u32(seed, *parts), F.lit(timesteps)).cast("int")
