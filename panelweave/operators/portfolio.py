"""Decile portfolios, rebalanced monthly and held in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Expr
from .metrics import TRADING_DAYS_PER_YEAR, decile_membership, ranked_signals

DECILES = 10


@dataclass(frozen=True)
class DecileResult:
    """daily: t, date, bucket ("1".., "market"), ret. spread: t, date, spread, excess."""

    daily: DataFrame
    spread: DataFrame


def rebalance_days(panel: DataFrame, warmup: int) -> DataFrame:
    """t, date, is_rebalance, held: the last session of each month from max(warmup, 1) on; held is the latest one up to t."""
    days = panel.select("t", "date").distinct()
    order = Window.orderBy("t")
    following = F.lead("date").over(order)
    last = following.isNotNull() & (F.trunc("date", "month") != F.trunc(following, "month")) & (F.col("t") >= max(warmup, 1))
    days = days.withColumn("is_rebalance", F.coalesce(last, F.lit(False)))
    return days.withColumn("held", F.last(F.when(F.col("is_rebalance"), F.col("t")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def decile_returns(panel: DataFrame, tree: Expr, buckets: int = DECILES, lag: bool = True, compat: bool = False) -> DecileResult:
    """Equal-weight returns of the tree's buckets and of the whole market.

    lag: a book formed at t earns from t+1 on. compat: the book earns its formation session too,
    reported one row later (how such results are sometimes published). Without lag it earns from t on.
    """
    days = rebalance_days(panel, tree.warmup)
    formed = days.where("is_rebalance").select("t")
    members = decile_membership(ranked_signals(panel, [tree], sessions=formed), buckets).select(F.col("t").alias("held"), "inst", "bucket")
    order = Window.orderBy("t")
    if lag and not compat:
        days = days.withColumn("held", F.lag("held").over(order))
    days = days.select("t", "date", "held")
    cells = panel.select("t", "inst", "returns").join(F.broadcast(days), "t").where("held IS NOT NULL AND returns IS NOT NULL")
    book = cells.join(members, ["held", "inst"]).groupBy("t", "date", F.col("bucket").cast("string").alias("bucket")).agg(F.avg("returns").alias("ret"))
    market = cells.groupBy("t", "date").agg(F.avg("returns").alias("ret")).select("t", "date", F.lit("market").alias("bucket"), "ret")
    daily = book.unionByName(market)
    if lag and compat:
        following = days.select("t", "date").withColumn("t2", F.lead("t").over(order)).withColumn("date2", F.lead("date").over(order))
        daily = daily.join(F.broadcast(following), ["t", "date"]).where("t2 IS NOT NULL").select(F.col("t2").alias("t"), F.col("date2").alias("date"), "bucket", "ret")
    wide = daily.groupBy("t", "date").pivot("bucket", ["1", str(buckets), "market"]).agg(F.first("ret"))
    spread = wide.select("t", "date", (F.col(f"`{buckets}`") - F.col("`1`")).alias("spread"), (F.col(f"`{buckets}`") - F.col("market")).alias("excess"))
    return DecileResult(daily, spread)


def to_monthly(daily: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """Compounded returns of each month."""
    rows = daily.where(F.col(value).isNotNull())
    return rows.groupBy(*by, F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col(value)) - 1).alias(value))


def annualise(daily: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """Growth to the power of a year over its sessions, less one; missing where growth isn't positive."""
    rows = daily.where(F.col(value).isNotNull())
    growth, n = F.product(1 + F.col(value)), F.count(value)
    year = F.when((growth > 0) & (n > 0), F.pow(growth, F.lit(float(TRADING_DAYS_PER_YEAR)) / n) - 1)
    return rows.groupBy(*by).agg(year.alias("annualised"))


def compare_monthly(monthly: DataFrame, factor: DataFrame, least: int = 24) -> DataFrame:
    """correlation and months of two monthly series (month, ret) and (month, factor) where both exist; missing below `least` months."""
    both = monthly.join(factor, "month").dropna()
    across = F.sqrt(F.var_pop("ret") * F.var_pop("factor"))
    corr = F.try_divide(F.covar_pop("ret", "factor"), across)
    return both.agg(F.when(F.count("*") >= least, corr).alias("correlation"), F.count("*").alias("months"))
