"""Identifier handling and engine-independent pseudo-random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NINE_DIGITS = r"(?<![0-9])([0-9]{9})(?![0-9])"


def canonical_article_id(c: Column | str) -> Column:
    """``N`` and the one run of nine digits in the value; NULL where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, _NINE_DIGITS, 1)
    return F.when(digits != "", F.concat(F.lit("N"), digits))


def md5_uniform(*parts: Column | str, seed: int = 13) -> Column:
    """A number in [0, 1) that depends on the parts and the seed only.

    Thirty-two bits of an md5 digest: the same in every engine and under every
    partitioning, which ``rand(seed)`` is not.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
