"""Random numbers that depend on their labels alone: the same on every run, in any partition and in SQL.

A uniform number is 13 hexadecimal digits of the MD5 of the labels joined by
bars; the first 13 and the next 13 give a pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(2**52)


def digest(*labels: Column) -> Column:
    return F.md5(F.concat_ws("|", *[x.cast("string") for x in labels]))


def half(h: Column, at: int = 1) -> Column:
    """A number in (0, 1) from 13 digits of a digest."""
    return (F.conv(F.substring(h, at, 13), 16, 10).cast("bigint") + 0.5) / F.lit(SCALE)


def normal(h: Column) -> Column:
    """A standard normal number from a digest."""
    return F.sqrt(-2 * F.ln(half(h))) * F.cos(2 * math.pi * half(h, 14))


def uniforms(prefix: str, n: int) -> np.ndarray:
    """Numbers of the labels prefix|0 ... prefix|n-1."""
    return np.array([(int(hashlib.md5(f"{prefix}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / SCALE for i in range(n)])


def half_sql(h: str, at: int = 1) -> str:
    return f"((('0x' || substr({h}, {at}, 13))::bigint + 0.5::double) / {SCALE!r}::double)"


def normal_sql(h: str) -> str:
    return f"(sqrt(-2 * ln({half_sql(h)})) * cos(2 * pi() * {half_sql(h, 14)}))"
