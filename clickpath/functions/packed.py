"""Ordered keys of fixed width: (time, id, code) as one ``decimal(38,0)``.

Hash aggregation needs buffers of fixed width, so the minimum of a struct, or
the string of the earliest row, is planned as a sort of all rows. The
minimum of one packed number is hash-aggregated and combined map-side:

    key = (time * ID_BASE + id) * codes + code

``time`` counts microseconds from the year 1 and ``id`` from the smallest
long; both start at 1, and 0 stands for null, so nulls come first as they do
in a struct. All calendar dates and all longs fit beside up to
``MAX_CODES`` codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_YEAR_ONE = "0001-01-01"
_DAY_US = 86_400_000_000
_LAST_US = 3_652_059 * _DAY_US  # up to the end of the year 9999
ID_BASE = (1 << 64) + 1
MAX_CODES = (10 ** 38 - 1) // ((_LAST_US + 1) * ID_BASE)


def _big(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def micros(ts: str, dtype: T.DataType) -> Column:
    """Microseconds since the year 1 of a date or timestamp column, in the order of the column."""
    days = F.datediff(F.to_date(ts), F.lit(_YEAR_ONE).cast("date")).cast("bigint")
    if isinstance(dtype, T.DateType):
        return days * _DAY_US
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(ts)) + F.lit(719_162 * _DAY_US)
    # parts, not a cast: a timestamp without zone must not depend on the session's
    clock = F.hour(ts).cast("bigint") * 3600 + F.minute(ts) * 60
    return days * _DAY_US + clock * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


#: Above all results of :func:`double_order`.
DOUBLE_END = 63 << 52


def double_order(value: Column) -> Column:
    """A long in the order of doubles from 1 up to 2^63: the exponent, then the 52 bits of the fraction, both exact."""
    guess = F.floor(F.log2(value)).cast("int")
    exponent = F.when(value < F.pow(F.lit(2.0), guess), guess - 1).when(value >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    fraction = (value / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))
    return exponent.cast("bigint") * (1 << 52) + fraction.cast("bigint")


def packed_key(time: Column, key: Column, code: Column | None = None, codes: int = 1, most: int = _LAST_US) -> Column:
    """``time`` (from :func:`micros`) and a long ``key``, with an int ``code`` from 0 to ``codes - 1`` that does not order.

    Times up to ``most`` only (a time of day, say) leave room for more codes than ``MAX_CODES``.
    """
    room = (10 ** 38 - 1) // ((most + 1) * ID_BASE)
    if not 1 <= codes <= room:
        raise ValueError(f"a packed key has room for {room} codes, not {codes}")
    t = F.coalesce(time + 1, F.lit(0)).cast("decimal(18,0)")
    i = F.coalesce(key.cast("decimal(19,0)") + _big((1 << 63) + 1), _big(0)).cast("decimal(20,0)")
    low = i if code is None else (i * codes).cast("decimal(25,0)") + code.cast("decimal(6,0)")
    return (t * _big(ID_BASE * codes) + low).cast("decimal(38,0)")


def packed_id(packed: Column, codes: int = 1) -> Column:
    """The ``key`` of a packed number."""
    low = (packed % _big(ID_BASE * codes)).cast("decimal(25,0)")
    i = low if codes == 1 else ((low - packed_code(packed, codes)) / codes).cast("decimal(20,0)")
    return F.when(i > 0, (i - _big((1 << 63) + 1)).cast("bigint"))


def packed_code(packed: Column, codes: int) -> Column:
    """The ``code`` of a packed number."""
    return (packed % codes).cast("int")
