"""Small helpers for tests: hand-written funnel tables and result comparison."""

from __future__ import annotations

import datetime as dt
import decimal

from clickpath.operators.cleaning import clean_sessions, with_gross_profit, with_page_name
from clickpath.sources.ingest import SCHEMAS


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def _schema(table: str) -> str:
    parts = []
    for name, dtype in SCHEMAS[table]:
        parts.append(f"{name} {'timestamp_ntz' if dtype == 'timestamp' else dtype}")
    return ", ".join(parts)


def tables(spark, sessions=(), pageviews=(), orders=(), items=(), refunds=(), products=None) -> dict:
    """Six cleaned funnel tables from row tuples in the raw column order."""
    D = decimal.Decimal
    if products is None:
        products = [(1, ts("2023-03-01 00:00:00"), "The Original Mr. Fuzzy"),
                    (2, ts("2023-06-01 00:00:00"), "The Forever Love Bear"),
                    (3, ts("2023-09-01 00:00:00"), "The Birthday Sugar Panda"),
                    (4, ts("2023-12-01 00:00:00"), "The Hudson River Mini bear")]
    conv = lambda rows, money_idx: [tuple(D(str(v)) if i in money_idx and v is not None else v
                                          for i, v in enumerate(r)) for r in rows]
    raw = {
        "sessions": spark.createDataFrame(list(sessions), _schema("sessions")),
        "pageviews": spark.createDataFrame(list(pageviews), _schema("pageviews")),
        "orders": spark.createDataFrame(conv(orders, {6, 7}), _schema("orders")),
        "order_items": spark.createDataFrame(conv(items, {5, 6}), _schema("order_items")),
        "order_item_refunds": spark.createDataFrame(conv(refunds, {4}), _schema("order_item_refunds")),
        "products": spark.createDataFrame(list(products), _schema("products")),
    }
    out = {f"raw_{k}": v for k, v in raw.items()}
    out.update(raw)
    out["sessions"] = clean_sessions(raw["sessions"])
    out["pageviews"] = with_page_name(raw["pageviews"])
    out["orders"] = with_gross_profit(raw["orders"])
    out["order_items"] = with_gross_profit(raw["order_items"])
    return out


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def rows(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, rows([r.asDict() for r in df.collect()], cols)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    recs = [dict(zip(names, r)) for r in cur.fetchall()]
    cols = sorted(names)
    return cols, rows(recs, cols)
