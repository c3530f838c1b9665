"""Product pairs within orders, from one pass over the lines.

Lines are reduced to one row for each (order, product) with its counts as a
primary and as a further item. Orders then become small groups that list both
sides, so no row meets another through a join. An order of many products is
dealt into slots, and each pair of slots is a group of its own: no task ever
holds more than two blocks of an order, even if one order has a third of all
lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products of an order that are listed in one group.
BLOCK = 1024


def product_counts(lines: DataFrame, order: str = "order_id", product: str = "product_id", primary: str = "is_primary_item") -> DataFrame:
    """``(order, product, n_primary, n_further)``: lines whose flag is 1 and 0; other flags count as neither."""
    return lines.groupBy(F.col(order).alias("order"), F.col(product).alias("product")).agg(
        F.count_if(F.col(primary) == 1).alias("n_primary"), F.count_if(F.col(primary) == 0).alias("n_further"))


def basket_pairs(lines: DataFrame, order: str = "order_id", product: str = "product_id", primary: str = "is_primary_item", block: int = BLOCK) -> DataFrame:
    """``(primary, further, times, primary_items)``: pairs of (primary line, further line) of one order, by product.

    ``primary_items`` counts the primary lines of ``primary`` over all orders, those without a further line too
    (NULL for a NULL product). Lines without an order pair with nothing, as in a join.
    """
    counts = product_counts(lines, order, product, primary)
    # reads both counts and compares null-safely, so that it is the same exchange as `counts` below and not another scan
    wide = counts.groupBy("order").agg(F.count_if(F.col("n_primary") + F.col("n_further") >= 0).alias("size")).filter(F.col("size") > block)
    wide = wide.select(F.col("order").alias("wide_order"), F.ceil(F.col("size") / block).cast("int").alias("slots"))
    dealt = counts.join(wide, F.col("order").eqNullSafe(F.col("wide_order")), "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("product"), F.col("slots")).cast("int"))
    item = F.struct("product", F.col("n_primary").alias("p"), F.col("n_further").alias("f"))
    every = F.sequence(F.lit(0), F.col("slots") - 1)
    # a primary row goes to all groups of its own row of the grid of slots, a further one to those of its column
    sides = F.explode(F.concat(
        F.when(F.col("n_primary") > 0, F.transform(every, lambda s: F.struct(F.lit(True).alias("first"), F.col("own").alias("i"), s.alias("j")))).otherwise(F.array()),
        F.when(F.col("n_further") > 0, F.transform(every, lambda s: F.struct(F.lit(False).alias("first"), s.alias("i"), F.col("own").alias("j")))).otherwise(F.array())))
    cells = dealt.select("order", "product", "n_primary", "n_further", sides.alias("at"), item.alias("item"))
    groups = cells.groupBy("order", "at.i", "at.j").agg(
        F.collect_list(F.when(F.col("at.first"), F.col("item"))).alias("firsts"), F.collect_list(F.when(~F.col("at.first"), F.col("item"))).alias("others"))
    # every primary row is in column 0 of its row once: there it also counts itself, against no product
    rows = groups.select("order", "j", F.explode("firsts").alias("a"), "others").select(
        F.col("a.product").alias("primary"), F.col("a.p").alias("p"), F.explode(F.concat(
            F.when(F.col("order").isNull(), F.array()).otherwise(F.transform("others", lambda b: F.struct(b["product"].alias("further"), (F.col("a.p") * b["f"]).alias("n"), F.lit(False).alias("own")))),
            F.when(F.col("j") == 0, F.array(F.struct(F.lit(None).cast(lines.schema[product].dataType).alias("further"), F.col("a.p").alias("n"), F.lit(True).alias("own")))).otherwise(F.array()))).alias("b"))
    counts = rows.groupBy("primary", "b.further", "b.own").agg(F.sum("b.n").alias("n"))
    # at most (products + 1) rows for each primary product
    total = F.max(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("primary"))
    counts = counts.withColumn("primary_items", F.when(F.col("primary").isNotNull(), total)).filter(~F.col("own"))
    return counts.select("primary", "further", F.col("n").alias("times"), "primary_items")
