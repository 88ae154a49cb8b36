"""Column functions that several operators use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mix_key(u: Column, v: Column) -> Column:
    """An integer order key that any SQL engine can compute: a fixed linear mix of two ids."""
    return F.pmod(u * F.lit(7919) + v * F.lit(104729), F.lit(1000003))


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform double in [0, 1), a function of seed and keys alone, so retries and partitionings don't change it."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def md5_uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform double in [0, 1) from 52 bits of the md5 of seed and keys, as any SQL engine can make it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def md5_below(seed: int, chance: float, *keys: Column | str) -> Column:
    """md5_uniform(seed, *keys) < chance, told from the hexadecimal digits themselves."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    least = math.ceil(chance * (1 << 52))
    return F.lit(True) if least >= 1 << 52 else F.substring(F.md5(text), 1, 13) < F.lit(f"{max(0, least):013x}")


def hash_normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal double by Box and Muller's rule from two hash uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_uniform(2 * seed, *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * hash_uniform(2 * seed + 1, *keys))


def hash_mask(seed: int, *keys: Column | str) -> Column:
    """A mask entry: a digit 0..9 plus a uniform fraction."""
    return hash_uniform(seed, *keys) * F.lit(10.0)


def guarded_inverse(x: Column) -> Column:
    """1 / x, and 0 where x is 0."""
    return F.when(x != 0, F.lit(1.0) / x).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, with zero instead of minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def tile(rank: Column, total: Column, k: int) -> Column:
    """The tile 1..k of a 1-based rank: near-equal runs, the first total mod k of which have one more, as NTILE has it."""
    small = F.floor(total / k).cast("long")
    extra = total - small * k
    cut = extra * (small + 1)
    late = F.when(small > 0, extra + F.floor((rank - 1 - cut) / small) + 1).otherwise(F.lit(k))
    return F.when(rank <= cut, F.floor((rank - 1) / (small + 1)) + 1).otherwise(late).cast("int")
