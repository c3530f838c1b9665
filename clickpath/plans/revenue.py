"""Revenue, margin and refunds per product and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, money_pct, month_of, pct, year_of
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis


@analysis("q01_1_product_margin", "A", also=("C",), order=('-Revenue',))
def product_margin(f: Funnel) -> DataFrame:
    """Per product (item-level prices): revenue, COGS, gross profit, margin %."""
    items = f["order_items"].select("product_id", "price_usd", "cogs_usd", "gross_profit")
    by_product = items.groupBy("product_id").agg(
        F.sum("price_usd").alias("rev"), F.sum("cogs_usd").alias("cogs"), F.sum("gross_profit").alias("gp"))
    g = (f["products"].select("product_id", "product_name").join(by_product, "product_id")
         .groupBy("product_name").agg(F.sum("rev").alias("rev"), F.sum("cogs").alias("cogs"),
                                      F.sum("gp").alias("gp")))
    return g.select(
        F.col("product_name").alias("Product"),
        F.col("rev").cast(MONEY).alias("Revenue"),
        F.col("cogs").cast(MONEY).alias("COGS"),
        F.col("gp").cast(MONEY).alias("Gross_Profit"),
        money_pct("gp", "rev").alias("Margin_Pct"),
    )


@analysis("q01_2_monthly_margin", "A", also=("C",), order=('Year', 'Month'))
def monthly_margin(f: Funnel) -> DataFrame:
    """Per calendar month of order: revenue, gross profit, margin %, orders."""
    o = f["orders"]
    g = o.groupBy(year_of("created_at").alias("Year"), month_of("created_at").alias("Month")).agg(
        F.sum("price_usd").alias("rev"), F.sum("gross_profit").alias("gp"),
        F.count("order_id").alias("Order_Count"))
    return g.select("Year", "Month", F.col("rev").cast(MONEY).alias("Revenue"),
                    F.col("gp").cast(MONEY).alias("Gross_Profit"),
                    money_pct("gp", "rev").alias("Margin_Pct"), "Order_Count")


@analysis("q01_3_refund_rate", "A", also=("C",), order=('-Refund_Rate_Pct',))
def refund_rate(f: Funnel) -> DataFrame:
    """Per product: items sold, refunds, refund %, revenue lost (NULL when nothing was refunded).

    Items are joined to refunds and reduced to one row per product id before
    the product names come in, so the fact join never carries a name column.
    """
    items = f["order_items"].select("order_item_id", "product_id")
    # refunds reduced to one row per item first: the outer join's right side is unique per key
    refunds = f["order_item_refunds"].groupBy("order_item_id").agg(
        F.count("order_item_refund_id").alias("n_ref"), F.sum("refund_amount_usd").alias("amt"))
    joined = items.join(refunds, "order_item_id", "left")
    # each item row stands for max(1, refunds) rows of the item ⟕ refund join
    per_id = joined.groupBy("product_id").agg(
        F.sum(F.when(F.col("order_item_id").isNotNull(), F.greatest(F.coalesce("n_ref", F.lit(0)), F.lit(1)))
              ).alias("items"),
        F.sum(F.coalesce("n_ref", F.lit(0))).alias("refunds"),
        F.sum("amt").alias("lost"))
    g = (f["products"].select("product_id", "product_name").join(per_id, "product_id", "left")
         .groupBy("product_name").agg(
             F.coalesce(F.sum("items"), F.lit(0)).alias("Total_Items_Sold"),
             F.coalesce(F.sum("refunds"), F.lit(0)).alias("Total_Refunds"),
             F.sum("lost").alias("lost")))
    return g.select(F.col("product_name").alias("Product"), "Total_Items_Sold", "Total_Refunds",
                    pct("Total_Refunds", "Total_Items_Sold").alias("Refund_Rate_Pct"),
                    F.col("lost").cast(MONEY).alias("Revenue_Lost"))
