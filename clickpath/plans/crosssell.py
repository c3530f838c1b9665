"""Cross-sell: product pairs, single vs multi-item orders, take rate per primary product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, money_per_unit, pct
from clickpath.operators.baskets import basket_pairs
from clickpath.operators.funnel import share_of_total
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis
from clickpath.spec import ORDER_SINGLE, ORDER_TWO


@analysis("q08_1_pairs", "A", also=("C",), order=('-Times_Bought_Together',))
def pairs(f: Funnel) -> DataFrame:
    """Primary product × cross-sell product: times bought together, % of the primary's orders.

    Counted as coded: every (primary item, cross-sell item) pair of an order.
    """
    together = basket_pairs(f["order_items"]).select(
        F.col("primary").alias("Primary_Product_ID"), F.col("further").alias("CrossSell_Product_ID"),
        F.col("times").alias("Times_Bought_Together"), "primary_items")
    names = f["products"].select("product_id", "product_name")
    p1 = names.select(F.col("product_id").alias("Primary_Product_ID"), F.col("product_name").alias("Primary_Product"))
    p2 = names.select(F.col("product_id").alias("CrossSell_Product_ID"),
                      F.col("product_name").alias("CrossSell_Product"))
    # A pair group is keyed by ids and names together, as coded.
    rows = (together.join(p1, "Primary_Product_ID", "left").join(p2, "CrossSell_Product_ID", "left")
            .groupBy("Primary_Product_ID", "CrossSell_Product_ID", "Primary_Product", "CrossSell_Product")
            .agg(F.sum("Times_Bought_Together").alias("Times_Bought_Together"), F.max("primary_items").alias("primary_items")))
    return rows.select("Primary_Product", "CrossSell_Product", "Times_Bought_Together",
                       pct("Times_Bought_Together", "primary_items").alias("CrossSell_Rate_Pct"))


@analysis("q08_2_order_type", "A", also=("C",))
def order_type(f: Funnel) -> DataFrame:
    """Single-item vs other orders: orders, share, revenue, average order value."""
    o = f["orders"].select(
        F.when(F.col("items_purchased") == 1, ORDER_SINGLE).otherwise(ORDER_TWO).alias("Order_Type"),
        "order_id", "price_usd")
    g = o.groupBy("Order_Type").agg(F.count("order_id").alias("Order_Count"),
                                    F.sum("price_usd").cast(MONEY).alias("Total_Revenue"),
                                    F.count("price_usd").alias("n_priced"))
    g = share_of_total(g, "Order_Count", "Pct_Of_Orders")
    return g.select("Order_Type", "Order_Count", "Pct_Of_Orders", "Total_Revenue",
                    money_per_unit("Total_Revenue", "n_priced").alias("Avg_Order_Value"))


@analysis("q08_3_take_rate", "A", also=("C",), order=('-CrossSell_Rate_Pct',))
def take_rate(f: Funnel) -> DataFrame:
    """Per primary product: orders, orders with exactly two items, take rate %.

    Distinct orders are counted by first reducing to one row per
    (product, order) — a partial aggregate — instead of two DISTINCT counts.
    """
    prim = f["order_items"].filter(F.col("is_primary_item") == 1).select("order_id", "product_id")
    o = f["orders"].select("order_id", (F.col("items_purchased") == 2).cast("int").alias("is_two"))
    per_order = (prim.join(o, "order_id").groupBy("product_id", "order_id")
                 .agg(F.max("is_two").alias("is_two")))
    per_product = per_order.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("Total_Orders"), F.coalesce(F.sum("is_two"), F.lit(0)).alias("CrossSell_Orders"))
    rows = per_product.join(f["products"].select("product_id", "product_name"), "product_id", "left")
    return rows.select(F.col("product_name").alias("Primary_Product"), "Total_Orders",
                       F.col("CrossSell_Orders").cast("bigint").alias("CrossSell_Orders"),
                       pct("CrossSell_Orders", "Total_Orders").alias("CrossSell_Rate_Pct"))
