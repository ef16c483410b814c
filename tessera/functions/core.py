"""Scalar column helpers.

All helpers return ``Column`` expressions made of Spark built-ins, so they stay inside
whole-stage codegen. None of them evaluates data on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """Boolean that may arrive as a real boolean or as text ('True'/'false')."""
    return F.lower(col_or(c).cast("string")) == F.lit("true")


def safe_div(num, den, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or null."""
    num, den = col_or(num), col_or(den)
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(num / den)


def epoch_ms(ts) -> Column:
    """Milliseconds since the epoch as double, for TIMESTAMP or TIMESTAMP_NTZ (session TZ is UTC)."""
    return F.unix_micros(col_or(ts).cast("timestamp")) / F.lit(1000.0)


def words(text) -> Column:
    """Whitespace-separated words (like Python's ``str.split()``): no empty tokens."""
    return F.filter(F.split(F.coalesce(col_or(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text) -> Column:
    """Number of whitespace-separated words; 0 for null or blank text."""
    return F.size(words(text))


def regex(pattern: str, ignore_case: bool = False) -> str:
    """Java regex with Unicode classes (Python's \\w \\d \\b are Unicode by default)."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def md5_bucket(c, dim: int) -> Column:
    """int(md5(c), 16) % dim without overflow.

    The 128-bit digest is folded in four 32-bit words: acc = (acc * 2^32 + word) mod dim,
    which stays inside a long for any dim below 2^30.
    """
    if not 0 < dim < 2 ** 30:
        raise ValueError("dim must be in (0, 2^30)")
    h = F.md5(col_or(c))
    acc = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(4294967296) + word, F.lit(dim).cast("long"))
    return acc.cast("int")


def fround(c, digits: int = 0) -> Column:
    """Round half away from zero on the binary double: sign(x) * floor(|x| * 10^d + 0.5) / 10^d.

    ``F.round`` rounds the shortest decimal text of the double (65.75125 -> 65.7513 even when
    the stored binary value is 65.751249999...). This helper rounds the stored value, which is
    what C's ``round`` and most SQL engines do, so results agree across engines bit for bit.
    """
    x = col_or(c)
    m = float(10 ** digits)
    return (F.signum(x) * F.floor(F.abs(x) * m + F.lit(0.5)) / F.lit(m)).cast("double")
