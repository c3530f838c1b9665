"""Text that compares as a case-insensitive server does, without changing the values.

A collated column carries its comparison in its type: equality, ``IN``,
grouping, distinct counts and joins treat ``/Home``, ``/home`` and ``/home ``
as one value, while the stored text stays as it came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ignores case and trailing blanks.
COLLATION = "UTF8_LCASE_RTRIM"


def collated(df: DataFrame, columns, collation: str = COLLATION) -> DataFrame:
    """``df`` with the given string columns under ``collation``."""
    return df.withColumns({c: F.collate(c, collation) for c in columns})


def folded(column: str):
    """The one plain spelling of a collated value, for output."""
    return F.lower(F.rtrim(F.collate(column, "UTF8_BINARY")))
