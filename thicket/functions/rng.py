"""Randomness that is a function of a seed and a row's keys, so that plain SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(seed: int, n: int, keys: tuple[Column | str, ...]) -> Column:
    text = F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10)


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from 32 bits of md5 of the keys and the seed, joined by '|'."""
    return (_digits(seed, 8, keys).cast("double") + 0.5) / 4294967296.0


def hash_integer(seed: int, *keys: Column | str) -> Column:
    """A whole number below 2^60, from 15 hex digits of md5."""
    return _digits(seed, 15, keys).cast("long")
