"""Column expressions for counts, intervals and seeded uniforms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def sliced(batches: Iterator, rows: int = 64) -> Iterator:
    """Arrow batches cut into ones of a few rows, so that what becomes Python values at a time is small however long the rows are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_up(x: Column, places: int = 0) -> Column:
    """Nearest, halves upward, of values from zero on."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / F.lit(k)


def wilson(x: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of x in n; (0, 0) without observations."""
    n_, z2 = n.cast("double"), z * z
    p = x.cast("double") / F.when(n > 0, n_)
    middle = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = z * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    none = F.lit(0.0)
    return (
        F.when(n > 0, F.greatest(none, middle - half)).otherwise(none),
        F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(none),
    )


def seeded_key(seed: str, key: Column) -> Column:
    """Hex digest whose order is the seeded order of the keys."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_uniform(seed: str, i: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of the digest of "seed:bootstrap:i"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:bootstrap:"), i.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def feasible_values(c: Column, n: Column, floor: int = 10) -> Column:
    """How many counts a lone suppressed cell may hold: below the floor, or from n - floor + 1 (the floor at least) up to n."""
    return F.when(c < floor, F.least(F.lit(floor), n + 1)).otherwise(n - F.greatest(F.lit(floor), n - (floor - 1)) + 1)


def primary_suppressed(c: Column, n: Column, floor: int = 10) -> Column:
    return (n < floor) | (c < floor) | (n - c < floor)


def tokens_of(text: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token).cast("long")
