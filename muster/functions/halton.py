"""Halton sequence coordinates as integer arithmetic on a point index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits handled by one table lookup, per base: the tables have 256 and 243 entries.
CHUNK = {2: 8, 3: 5}
# Six chunks cover every index below 2 ** 48 (base 2) and 3 ** 30 (base 3). The mirrored
# numbers stay below 2 ** 53, so the one division at the end is exact or correctly rounded.
MAX_CHUNKS = 6


def digits_for(largest: int, base: int) -> int:
    """How many base-``base`` digits ``largest`` has."""
    count, power = 1, base
    while power <= largest:
        count, power = count + 1, power * base
    return count


def _mirror(number: int, base: int, digits: int) -> int:
    """``number`` with its ``digits`` base-``base`` digits in reverse order."""
    mirrored = 0
    for _ in range(digits):
        number, digit = divmod(number, base)
        mirrored = mirrored * base + digit
    return mirrored


def radical_inverse(index: str, base: int, largest: int | None = None) -> Column:
    """Column ``index`` mirrored at the radix point: 6 = 110 in base 2 becomes 0.011 = 0.375.

    A few digits at a time are mirrored through a literal table, which keeps the expression
    small enough to be compiled. ``largest`` bounds the index and so the number of chunks; an
    index with more digits than those cover is an error.
    """
    width = CHUNK[base]
    chunks = -(-digits_for(largest, base) // width) if largest else MAX_CHUNKS
    size = base**width
    # One literal as text: building it from single columns takes seconds on the driver.
    table = F.expr(f"array({', '.join(f'{_mirror(n, base, width)}L' for n in range(size))})")
    mirrored = F.lit(0).cast("bigint")
    for k in range(chunks):
        chunk = F.call_function("div", F.col(index), F.lit(size**k).cast("bigint")) % size
        mirrored = mirrored + F.get(table, chunk.cast("int")) * F.lit(size ** (chunks - 1 - k))
    covered = F.lit(size**chunks).cast("bigint")
    beyond = F.concat(F.lit(f"no base-{base} coordinate for index "), F.col(index).cast("string"))
    return F.when(F.col(index) >= covered, F.raise_error(beyond).cast("double")).otherwise(
        mirrored / F.lit(float(size**chunks))
    )
