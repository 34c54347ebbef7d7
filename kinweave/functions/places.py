"""Parts of postcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def postcode_part(c: Column, level: str) -> Column:
    """``area`` (leading letters), ``district`` (without the last three characters) or ``sector`` (without the last two)."""
    code = F.regexp_replace(c, "[^A-Za-z0-9]", "")
    if level == "area":
        return F.regexp_extract(code, "^[^0-9]*", 0)
    if level not in ("district", "sector"):
        raise ValueError("level is area, district or sector")
    return F.substring(code, F.lit(1), F.greatest(F.length(code) - (3 if level == "district" else 2), F.lit(0)))
