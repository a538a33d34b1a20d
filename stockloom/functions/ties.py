"""Ties between floating-point scores.

Sums come out a little different with the order of summation. Scores that agree to some places
are therefore ties, and an id decides. Keys are computed once per row, before any sort compares
them, in plain floating-point steps.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(score: Column, places: int) -> Column:
    return F.rint(score * 10.0**places) / 10.0**places


def tie_key(score: Column, places: int = 12) -> Column:
    """Equal for scores that agree to ``places`` places, else ordered like the scores."""
    return F.rint(score * 10.0**places)
