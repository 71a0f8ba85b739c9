"""Draws by a counter: a number for each set of keys, the same in every engine, whatever the partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and prime moduli below 2^31: every product fits 64 bits.
STEPS = ((48271, 2147483647), (1070000011, 2147483629), (742938285, 2147483587))


def _rounds(keys: list, zero):
    x = zero
    for key in keys:
        for k, (a, m) in enumerate(STEPS):
            x = (x * a + key) % m if k == 0 else (x * a + k) % m
    return x


def uniform(*keys: Column) -> Column:
    """Between 0 and 1, from whole keys of 0 to 2^31."""
    return (_rounds([k.cast("long") for k in keys], F.lit(1).cast("long")) + F.lit(0.5)) / F.lit(float(STEPS[-1][1]))


def uniform_array(*keys) -> np.ndarray:
    """The same for numpy arrays of whole numbers, which are broadcast together."""
    return (_rounds([np.asarray(k, np.int64) for k in keys], np.int64(1)) + 0.5) / float(STEPS[-1][1])


def uniform_sql(*keys: str) -> str:
    """The same as an SQL expression."""
    x = "1::BIGINT"
    for key in keys:
        for k, (a, m) in enumerate(STEPS):
            x = f"(({x} * {a} + {key if k == 0 else k}) % {m})"
    return f"(({x} + 0.5::DOUBLE) / {STEPS[-1][1]}.0::DOUBLE)"


def text_key(text: Column) -> Column:
    """A text as a key: the first seven hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def text_key_sql(text: str) -> str:
    return f"('0x' || substring(md5({text}), 1, 7))::BIGINT"
