"""Array algebra on columns; everything stays in JVM expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def sq_dist(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def columns(x: Column, width: int, name: str) -> list[Column]:
    """The entries of an array as columns name0, name1, ..., null where it is shorter. Arithmetic
    on them is compiled, where higher-order functions are interpreted."""
    return [F.get(x, F.lit(i)).alias(f"{name}{i}") for i in range(width)]


def sum_of(terms: list[Column]) -> Column:
    """The sum in the order of ``total``."""
    return sum(terms, F.lit(0.0))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def unit(x: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    n = norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def signed_round(v: Column, digits: int = 6) -> Column:
    """Rounded with the sign kept, as IEEE arithmetic has it: a small negative number becomes
    -0.0, which ``round`` alone, going through decimals, gives as 0.0."""
    return F.signum(v) * F.round(F.abs(v), digits)


def near_round(v: Column, digits: int = 6) -> Column:
    """``round`` of a double. It goes through decimals only near a half or for large numbers;
    elsewhere the nearest integer over a power of ten is the same double."""
    t = v * 10.0**digits
    return F.when((F.abs(t) < 1e8) & (F.abs(t - F.rint(t)) < 0.499999), F.rint(t).cast("long") / F.lit(10.0**digits)).otherwise(F.round(v, digits))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.transform(x, lambda v: signed_round(v, digits))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def numbers(n: Column) -> Column:
    """0 to n - 1, for n of at least 1."""
    return F.sequence(F.lit(0), n - 1)


def log_sum_exp(x: Column) -> Column:
    """The log of the sum of exponentials of an array."""
    return let(x, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda a: F.exp(a - top))))))
