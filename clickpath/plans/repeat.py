"""New vs returning behaviour, repeat purchases and monthly cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpath.functions.metrics import (
    MONEY, avg_2dp_decimal, money_pct, money_per_unit, month_diff, month_floor, month_of, pct,
    year_of,
)
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis
from clickpath.spec import SEGMENT_NEW, SEGMENT_RETURNING


@analysis("q02_1_new_vs_returning", "A")
def new_vs_returning(f: Funnel) -> DataFrame:
    """Per segment over sessions ⟕ orders ⟕ items, counting joined rows as coded.

    The item fan-out is computed per order and per session *before* the
    session join: each order contributes ``max(1, items)`` joined rows and
    ``items_purchased`` once per such row, so the session table is shuffled
    once and never multiplied.
    """
    items = f["order_items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("price_usd").alias("rev"), F.sum("gross_profit").alias("gp"))
    per_order = (f["orders"].select("order_id", "website_session_id", "items_purchased")
                 .join(items, "order_id", "left")
                 .select("website_session_id",
                         F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(1)).alias("rows"),
                         (F.col("items_purchased") * F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(1)))
                         .alias("volume"), "rev", "gp"))
    per_session = per_order.groupBy("website_session_id").agg(
        F.sum("rows").alias("rows"), F.sum("volume").alias("volume"),
        F.sum("rev").alias("rev"), F.sum("gp").alias("gp"))
    segment = (F.when(F.col("is_repeat_session") == 0, SEGMENT_NEW)
               .when(F.col("is_repeat_session") == 1, SEGMENT_RETURNING))
    g = (f["sessions"].select("website_session_id", segment.alias("Customer_Segment"))
         .join(per_session, "website_session_id", "left")
         .groupBy("Customer_Segment").agg(
             F.sum("volume").cast("bigint").alias("Volume"),
             F.sum("rev").cast(MONEY).alias("Revenue"),
             F.sum("gp").cast(MONEY).alias("Gross_Profit"),
             F.sum(F.coalesce("rows", F.lit(1))).cast("bigint").alias("joined_rows")))
    return g.select("Customer_Segment", "Volume", "Revenue", "Gross_Profit",
                    money_pct("Gross_Profit", "Revenue").alias("Margin_Pct"),
                    money_per_unit("Revenue", "joined_rows").alias("Revenue_Per_Session"))


@analysis("q02_2_repeat_product_rate", "A", order=('-Repeat_Purchases_Per_Month',))
def repeat_product_rate(f: Funnel) -> DataFrame:
    """Per product bought in repeat sessions: months in market, purchases, purchases per month (integer)."""
    repeat_sessions = f["sessions"].filter(F.col("is_repeat_session") == 1).select("website_session_id")
    o = f["orders"].select("order_id", "website_session_id").join(repeat_sessions, "website_session_id", "left_semi")
    # Items are reduced to one row per (order, product) before the join, so an order with a
    # huge number of items is one small row set on the right side of the outer join.
    items = f["order_items"].groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("item_ts"))
    rows = (o.join(items, "order_id", "left")
            .join(f["products"].select("product_id", "product_name", F.col("created_at").alias("launch")),
                  "product_id", "left"))
    # COUNT(product_name) over the item rows = the item count where the product is known
    g = rows.groupBy("product_name", "launch").agg(
        F.max("item_ts").alias("last_item"),
        F.coalesce(F.sum(F.when(F.col("product_name").isNotNull(), F.col("n"))), F.lit(0)).alias("Purchase_Count"))
    months = month_diff("launch", "last_item")
    return g.select(
        F.col("product_name").alias("Product"), F.col("launch").alias("Launch_Date"),
        months.alias("Months_In_Market"), "Purchase_Count",
    ).withColumn("Repeat_Purchases_Per_Month",
                 F.expr("Purchase_Count div nullif(Months_In_Market, 0)"))


@analysis("q02_3_repeat_session_rate", "A", order=('Year', 'Month'))
def repeat_session_rate(f: Funnel) -> DataFrame:
    """Per calendar month: sessions, repeat sessions, repeat %."""
    s = f["sessions"]
    g = s.groupBy(year_of("created_at").alias("Year"), month_of("created_at").alias("Month")).agg(
        F.count(F.lit(1)).alias("All_Sessions"),
        F.count(F.when(F.col("is_repeat_session") == 1, F.col("website_session_id"))).alias("Repeat_Sessions"))
    return g.select("Year", "Month", "All_Sessions", "Repeat_Sessions",
                    pct("Repeat_Sessions", "All_Sessions").alias("Pct_Repeat_Sessions"))


@analysis("q02_4_orders_per_user", "A")
def orders_per_user(f: Funnel) -> DataFrame:
    """Mean orders per ordering user, DECIMAL(10,2), from an exact sum and count."""
    per_user = f["orders"].groupBy("user_id").agg(F.count("order_id").alias("c"))
    g = per_user.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("users"))
    return g.select(avg_2dp_decimal("total", "users").alias("Avg_Orders_Per_Converting_User"))


@analysis("q02_5_cohort_retention", "B", order=('Cohort_Month', 'Months_Since_First_Purchase'))
def cohort_retention(f: Funnel) -> DataFrame:
    """First-order month cohorts × months since: users ordering again, cohort size, retention %.

    Orders are first reduced to distinct (user, order month) pairs; a user then
    has at most one row per month, so the per-user window that finds the
    cohort is bounded however many orders one user places.
    """
    um = (f["orders"].filter(F.col("user_id").isNotNull())
          .select("user_id", month_floor("created_at").alias("order_month")).distinct())
    um = um.withColumn("Cohort_Month", F.min("order_month").over(Window.partitionBy("user_id")))
    um = um.withColumn("Months_Since_First_Purchase", month_diff("Cohort_Month", "order_month"))
    size = um.filter(F.col("Months_Since_First_Purchase") == 0).groupBy("Cohort_Month").agg(
        F.count(F.lit(1)).alias("Cohort_Size"))
    retained = (um.filter(F.col("Months_Since_First_Purchase") > 0)
                .groupBy("Cohort_Month", "Months_Since_First_Purchase")
                .agg(F.count(F.lit(1)).alias("Retained_Users")))
    return (retained.join(size, "Cohort_Month")
            .select("Cohort_Month", "Months_Since_First_Purchase", "Retained_Users", "Cohort_Size",
                    pct("Retained_Users", "Cohort_Size").alias("Retention_Pct")))
