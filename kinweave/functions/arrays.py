"""Arrays of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import join_text


def pick(c: Column, index: int | tuple[int, int], sep: str = " ") -> Column:
    """The element at ``index`` (0 is the first, negative from the end, null out of range), or those of [a, b) joined."""
    if isinstance(index, int):
        return F.get(c, F.lit(index)) if index >= 0 else F.try_element_at(c, F.lit(index))
    a, b = index
    n = F.size(c)
    at = F.greatest(F.lit(a) if a >= 0 else n + a, F.lit(0))
    end = F.least(F.lit(b) if b >= 0 else n + b, n)
    return join_text([F.array_join(F.slice(c, at + 1, F.greatest(end - at, F.lit(0))), sep)], sep)
