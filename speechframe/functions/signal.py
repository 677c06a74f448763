"""Features of signals held as arrays of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))).otherwise(0.0)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def gained(x: Column, target: float = 0.1, floor: float = 0.0005) -> Column:
    """Brought to a level, clipped to [-1, 1]; null for silence."""
    g = F.lit(target) / rms(x)
    return F.when(rms(x) >= floor, F.transform(x, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v * g))))


def first_channel(x: Column, channels: int) -> Column:
    return F.filter(x, lambda v, i: i % channels == 0)


def mean_channels(x: Column, channels: int) -> Column:
    n = F.floor(F.size(x) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(x, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, v: a + v) / channels)


def mixed(a: Column, b: Column, gain: float = 0.71, limit: float = 0.99) -> Column:
    """Two signals, the shorter padded with silence, scaled down where the sum passes the limit, as 16-bit integers."""
    s = F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) * gain)
    top = peak(s)
    return F.transform(s, lambda v: F.floor(F.when(top > limit, v * (F.lit(limit) / top)).otherwise(v) * 32767).cast("int"))


def fitted(x: Column, n: int) -> Column:
    """Exactly n samples: the middle of a longer signal, a shorter one repeated."""
    off = F.floor((F.size(x) - n) / 2).cast("int")
    times = F.ceil(F.lit(n) / F.size(x)).cast("int")
    return F.when(F.size(x) >= n, F.slice(x, off + 1, F.lit(n))).when(F.size(x) > 0, F.slice(F.flatten(F.array_repeat(x, times)), 1, n))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(x: pd.Series, rate_in: pd.Series, rate_out: pd.Series) -> pd.Series:
    """Linear interpolation; enough to judge boundaries, not quality."""

    def one(v, a, b):
        v = np.asarray(v, float)
        if a == b or not len(v):
            return v
        n = int(round(len(v) * b / a))
        return np.interp(np.linspace(0, 1, n, endpoint=False), np.linspace(0, 1, len(v), endpoint=False), v)

    return pd.Series([one(*t) for t in zip(x, rate_in, rate_out)])


def quiet_cut(levels: Column, width: int) -> Column:
    """The index at which a moving mean of ``width`` levels is least, the first of equals."""
    n = F.size(levels) - width + 1
    means = F.transform(F.sequence(F.lit(1), n), lambda i: F.round(F.aggregate(F.slice(levels, i, F.lit(width)), F.lit(0.0), lambda a, v: a + v) / width, 9))
    return F.when(n > 0, F.array_position(means, F.array_min(means)).cast("int") - 1)
