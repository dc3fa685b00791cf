"""Random numbers that depend on (seed, name, id) only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits hold 52 bits, the precision of a double's mantissa.
HEX_DIGITS = 13
UNIT = float(2**52)


def unit_hash(seed: int, name: str, id_col: Column | str) -> Column:
    """Uniform double in [0, 1) from md5('seed:name:id')."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.lit(f"{seed}:{name}:"), ident.cast("string"))
    digits = F.substring(F.md5(text), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(UNIT)


def inverse_uniform(u: Column, lower, upper) -> Column:
    """Inverse distribution function of the closed continuous range."""
    return lower + u * (upper - lower)


def inverse_discrete_uniform(u: Column, lower, upper) -> Column:
    """Inverse distribution function of the integers lower..upper."""
    return F.floor(lower + u * (upper - lower + 1)).cast("double")
