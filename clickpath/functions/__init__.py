from clickpath.functions.metrics import (  # noqa: F401
    MONEY, avg_2dp_decimal, day_diff, exact_mean, flag, half_up_ratio, map_values, money,
    money_pct, money_per_unit, month_diff, month_floor, month_of, pct, per_unit, to_cents, year_of,
)
