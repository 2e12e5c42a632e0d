"""Randomness as a pure function of (seed, row key, family, column, salt).

One md5 per row and seed gives a number below a prime; every mask and every pick is an
affine map of it with constants fixed per (family, column, salt). Results therefore do
not depend on row order, column order, partitioning or retries, and the rows hit at 10 %
are among those hit at 20 %.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def affine_constants(family: str, column: str, salt: str) -> tuple[int, int]:
    digest = hashlib.md5(f"{family}|{column}|{salt}".encode()).hexdigest()
    return 1 + int(digest[:12], 16) % (PRIME - 1), int(digest[12:24], 16) % PRIME


def row_hash(seed: Column | int, *key: Column) -> Column:
    """A number in [0, PRIME) per (seed, row key)."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in key]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def mixed(h: str, family: str, column: str, salt: str) -> str:
    a, b = affine_constants(family, column, salt)
    return f"(({h} * {a}L + {b}L) % {PRIME}L)"


def hit(h: str, family: str, column: str, severity: float | str) -> str:
    """SQL: true for about ``severity`` of the rows, drawn independently per column.

    ``h`` and a textual ``severity`` are column names. Text is used because a frame has
    dozens of such expressions and one text per column is built much faster than a tree.
    """
    severity = f"{severity!r}D" if isinstance(severity, float) else severity
    return f"({mixed(h, family, column, 'hit')} / {PRIME}.0D < {severity})"


def pick(h: str, family: str, column: str, n: int) -> str:
    """SQL: a number in [0, n), drawn apart from the hit."""
    return f"({mixed(h, family, column, 'pick')} % {n}L)"
