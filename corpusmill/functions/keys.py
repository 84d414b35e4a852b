"""A filter on a bounded list of keys that a parquet scan can use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PUSHED_KEYS = 10_000
#: Up to so many values (Spark's own default) an IN reaches parquet as equalities.
EXACT_VALUES = 10


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(terms: list[str]) -> str:
    """Balanced OR: a chain of thousands would be as deep as it is long."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({_any(terms[:half])} OR {_any(terms[half:])})"


def among(column: str, values: Iterable[str]) -> Column:
    """Whether a string column is one of at most ``MAX_PUSHED_KEYS`` values.

    The whole list decides, by a hash set. The same values in short lists come second:
    of a long list parquet compares the bounds of a page only with the least and the
    greatest value, of short ones with each, so that pages without a key are skipped.
    """
    keys = sorted(set(values))
    if len(keys) > MAX_PUSHED_KEYS:
        raise ValueError(f"{len(keys)} keys, at most {MAX_PUSHED_KEYS} are pushed")
    if not keys:
        return F.lit(False)

    def within(some: list[str]) -> str:
        return f"`{column}` IN ({', '.join(map(_literal, some))})"

    whole = within(keys)
    if len(keys) <= EXACT_VALUES:
        return F.expr(whole)
    parts = [within(keys[at:at + EXACT_VALUES]) for at in range(0, len(keys), EXACT_VALUES)]
    return F.expr(f"{whole} AND {_any(parts)}")
