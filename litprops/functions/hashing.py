"""Repeatable random order from md5 text: the same in every engine, on every retry, on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits, exact in a double


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_text(seed: int | str, *cols) -> Column:
    """md5 hex of ``seed:col1:col2...``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def hash_number(seed: int | str, *cols) -> Column:
    """Leading 52 bits of :func:`hash_text` as BIGINT; uniform on [0, 2**52)."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def hash_fraction(seed: int | str, *cols) -> Column:
    """:func:`hash_number` scaled to [0, 1)."""
    return hash_number(seed, *cols) / F.lit(float(2 ** (4 * _HEX_DIGITS)))


def pick(options: list, seed: int | str, *cols) -> Column:
    """One of ``options`` per row, by md5."""
    choice = F.pmod(hash_number(seed, *cols), F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), choice)
