"""Randomness by hash: results depend on ids and salts, never on partitioning."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(salt: str, *ids: Column) -> Column:
    """The first 13 hex digits of the SHA-256 of salt and ids, in the order of ``uniform``."""
    text = F.concat_ws("|", F.lit(salt), *(i.cast("string") for i in ids))
    return F.substring(F.sha2(text, 256), 1, 13)


def uniform(salt: str, *ids: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256 of salt and ids."""
    return F.conv(digits(salt, *ids), 16, 10).cast("double") / F.lit(2.0**52)


def fold(salt: str, group: Column, k: int) -> Column:
    """The SHA-256 of ``salt:group`` modulo k, over all 256 bits (Horner over 32-bit parts)."""
    text = F.sha2(F.concat(F.lit(f"{salt}:"), group.cast("string")), 256)
    r = F.lit(0).cast("long")
    for i in range(8):
        part = F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long")
        r = (r * F.lit(2**32 % k) + part) % k
    return r.cast("int")


#: Distribution function of a Poisson draw with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)


def poisson(salt: str, *ids: Column) -> Column:
    """A Poisson draw with mean 1: how many steps of the distribution function ``uniform`` reaches.
    The hash's digits are compared as text with those of each step."""
    drawn = digits(salt, *ids)
    return sum(((drawn >= F.lit(f"{math.ceil(c * 2.0**52):013x}")).cast("int") for c in POISSON), F.lit(0))


def normal(salt: str, *ids: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    u, v = uniform(salt + "|r", *ids), uniform(salt + "|a", *ids)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(6.283185307179586 * v)
