"""Counter-based randomness: a draw is a function of its key, so partitioning never changes a result."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """Uniform in (0, 1) from the first 52 bits of the key's md5; any SQL engine can repeat it."""
    digest = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def normal(*key: Column) -> Column:
    """Box-Muller on two uniforms of the key."""
    u, v = uniform(*key, F.lit("a")), uniform(*key, F.lit("b"))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def generator(*key) -> np.random.Generator:
    """A numpy stream of its own for a key: the fast path."""
    digest = xxhash.xxh128_intdigest("|".join(map(str, key)).encode())
    return np.random.Generator(np.random.Philox(key=digest))
