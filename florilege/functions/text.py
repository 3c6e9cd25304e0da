"""Column expressions for keys and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blank characters that do not count at the ends of a key.
BLANKS = " \t\n\r\x0b\x0c\x85                 　﻿"


def key(column: Column | str, lower: bool = False) -> Column:
    """A key or reference without blanks at its ends, null when nothing is left; lower case where case does not count."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.btrim(c, F.lit(BLANKS))
    return F.nullif(F.lower(c) if lower else c, F.lit(""))


def period(column: Column | str) -> Column:
    """The calendar month of a timestamp as YYYY-MM; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM")
