"""Scores of ranked signals against forward returns.

Signals come in long form: rows (k, t, inst, inst_idx, r), one per present value of signal k,
so one plan measures any number of signals. A signal at t is scored on the return over
t+1..t+h; that shift lives in forward_returns alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Expr
from ..plans.compiler import AXES, history, long_form, values_of

# Fixed values.
TRADING_DAYS_PER_YEAR = 252
MIN_CROSS_SECTION = 20


def forward_returns(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Axes and fwd: the compounded return over the next `horizon` rows; missing if one is."""
    if horizon < 1:
        raise ValueError("the horizon must be one session or more")
    growth: Column | None = None
    for k in range(1, horizon + 1):
        step = 1 + F.lead("returns", k).over(history())
        growth = step if growth is None else growth * step
    return panel.select(*AXES, (growth - 1).alias("fwd"))


def rank_long(values: DataFrame, value: str = "v", name: str = "r", strict: bool = False) -> DataFrame:
    """Centred ranks of long rows per (k, t), and the doubled whole positions p2 and sizes n they come from."""
    v = F.col(value).cast("float").cast("double") if strict else F.col(value)
    rows = values.withColumn(value, v).where(F.col(value).isNotNull())
    day = Window.partitionBy("k", "t")
    ties = F.count("*").over(Window.partitionBy("k", "t", value))
    p2 = 2 * (F.rank().over(day.orderBy(value)) - 1) + ties - 1
    rows = rows.withColumn("p2", p2.cast("long")).withColumn("n", F.count("*").over(day))
    return rows.withColumn(name, (F.col("p2") / 2 + 0.5) / F.col("n") - 0.5)


def ranked_forward(panel: DataFrame, horizon: int = 1, strict: bool = False) -> DataFrame:
    """t, inst, inst_idx and fr: forward returns ranked within each session."""
    rows = forward_returns(panel, horizon).select(F.lit(0).alias("k"), *AXES, F.col("fwd").alias("v"))
    return rank_long(rows, strict=strict).select("t", "inst", "inst_idx", F.col("r").alias("fr"))


def ranked_signals(panel: DataFrame, trees: list[Expr], strict: bool = False, sessions: DataFrame | None = None) -> DataFrame:
    """Long ranks of the trees from their warmup on. sessions: rank only these (t)."""
    values = values_of(panel, trees, strict=strict)
    if sessions is not None:
        values = values.join(F.broadcast(sessions), "t", "left_semi")
    rows = long_form(values, len(trees))
    start = F.create_map(*[F.lit(x) for i, t in enumerate(trees) for x in (i, t.warmup)])
    return rank_long(rows.where(F.col("t") >= start[F.col("k")]))


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs, missing where a side doesn't vary."""
    across = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), across)


def daily_rank_ic(ranks: DataFrame, forward: DataFrame, least: int = MIN_CROSS_SECTION) -> DataFrame:
    """k, t, ic, n: correlation of signal and forward ranks on cells that have both; days with fewer than `least` are missing.

    Ranks are those of each side's whole population and aren't taken again on the pairs.
    """
    pairs = ranks.join(forward.select("t", "inst", "fr"), ["t", "inst"])
    days = pairs.groupBy("k", "t").agg(F.count("*").alias("n"), pair_correlation(F.col("r"), F.col("fr")).alias("ic"))
    return days.where(F.col("n") >= least).where("ic IS NOT NULL")


def ic_summary(ics: DataFrame) -> DataFrame:
    """k, ic (mean), ic_ir (mean over sample deviation, annualised), n_scored_days."""
    spread = F.stddev_samp("ic")
    ratio = F.when((F.count("ic") >= 2) & (spread > 0), F.avg("ic") / F.nullif(spread, F.lit(0.0)) * math.sqrt(TRADING_DAYS_PER_YEAR))
    return ics.groupBy("k").agg(F.avg("ic").alias("ic"), ratio.alias("ic_ir"), F.count("ic").alias("n_scored_days"))


def turnover(ranks: DataFrame, panel: DataFrame, signals: int) -> DataFrame:
    """k, turnover: mean over all session changes of half the absolute change of gross-normalised weights.

    A missing rank is a zero weight: entering and leaving the book are trades of the whole weight,
    the leaving one on the session after the last. So present rows alone tell all changes.
    """
    gross = F.sum(F.abs("r")).over(Window.partitionBy("k", "t"))
    last = panel.agg(F.max("t").cast("int").alias("last"))
    held = ranks.withColumn("w", F.try_divide(F.col("r"), gross)).select("k", "t", "inst", F.coalesce("w", F.lit(0.0)).alias("w"))
    by = Window.partitionBy("k", "inst").orderBy("t")
    before = F.when(F.lag("t").over(by) == F.col("t") - 1, F.lag("w").over(by)).otherwise(F.lit(0.0))
    gone = ~F.coalesce(F.lead("t").over(by) == F.col("t") + 1, F.lit(False))
    steps = held.select("k", "t", F.abs(F.col("w") - before).alias("came"), F.when(gone, F.abs("w")).otherwise(0.0).alias("left")).crossJoin(F.broadcast(last))
    traded = F.when(F.col("t") > 0, F.col("came")).otherwise(0.0) + F.when(F.col("t") < F.col("last"), F.col("left")).otherwise(0.0)
    found = steps.groupBy("k").agg((F.sum(traded) / (2 * F.nullif(F.max("last"), F.lit(0)))).alias("turnover"))
    names = panel.sparkSession.range(signals).select(F.col("id").cast("int").alias("k"))
    return names.join(F.broadcast(found), "k", "left").crossJoin(F.broadcast(last)).where("last > 0").select("k", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def coverage(values: DataFrame, panel: DataFrame, trees: list[Expr]) -> DataFrame:
    """k, coverage: listed cells with a value over listed cells, from each tree's warmup on; 0 without cells.

    values: as values_of gives them, on the panel's grid.
    """
    listed = values.join(panel.select("t", "inst", "is_listed"), ["t", "inst"]).where("is_listed = 1")
    one = []
    for i, tree in enumerate(trees):
        ready = F.col("t") >= tree.warmup
        share = F.try_divide(F.count_if(ready & F.col(f"v{i}").isNotNull()), F.count_if(ready))
        one.append(F.struct(F.lit(i).alias("k"), F.coalesce(share, F.lit(0.0)).alias("coverage")))
    return listed.agg(F.array(*one).alias("all")).select(F.inline("all"))


def dispersion(ranks: DataFrame, least: int = MIN_CROSS_SECTION) -> DataFrame:
    """k, dispersion: root of the median over sessions (of at least `least` values) of the ranks' sample variance."""
    days = ranks.groupBy("k", "t").agg(F.count("*").alias("n"), F.var_samp("r").alias("v"))
    return days.groupBy("k").agg(F.coalesce(F.sqrt(F.median(F.when(F.col("n") >= least, F.col("v")))), F.lit(0.0)).alias("dispersion"))


def summarise(panel: DataFrame, trees: list[Expr], horizon: int = 1, forward: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """k, ic, ic_ir, turnover, coverage, dispersion, n_scored_days of every tree: one plan for the batch."""
    values = values_of(panel, trees, strict=strict)
    rows = long_form(values, len(trees))
    start = F.create_map(*[F.lit(x) for i, t in enumerate(trees) for x in (i, t.warmup)])
    ranks = rank_long(rows.where(F.col("t") >= start[F.col("k")])).select("k", "t", "inst", "inst_idx", "r")
    forward = ranked_forward(panel, horizon, strict) if forward is None else forward
    # One aggregate by session serves IC and dispersion.
    paired = ranks.join(forward.select("t", "inst", "fr"), ["t", "inst"], "left").withColumn("x", F.when(F.col("fr").isNotNull(), F.col("r")))
    days = paired.groupBy("k", "t").agg(F.count("fr").alias("n"), pair_correlation(F.col("x"), F.col("fr")).alias("ic"), F.count("*").alias("size"), F.var_samp("r").alias("v"))
    ics = F.when(F.col("n") >= MIN_CROSS_SECTION, F.col("ic"))
    scored = ic_summary(days.withColumn("ic", ics))
    spread = days.groupBy("k").agg(F.coalesce(F.sqrt(F.median(F.when(F.col("size") >= MIN_CROSS_SECTION, F.col("v")))), F.lit(0.0)).alias("dispersion"))
    names = panel.sparkSession.range(len(trees)).select(F.col("id").cast("int").alias("k"))
    out = names.join(scored, "k", "left").join(turnover(ranks, panel, len(trees)), "k", "left")
    out = out.join(coverage(values, panel, trees), "k", "left").join(spread, "k", "left")
    return out.select("k", "ic", "ic_ir", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), F.coalesce("n_scored_days", F.lit(0)).alias("n_scored_days"))


def daily_dispersion(panel: DataFrame, least: int = MIN_CROSS_SECTION) -> DataFrame:
    """t, vol: sample deviation of a session's returns; sessions with fewer than `least` are missing."""
    return panel.groupBy("t").agg(F.when(F.count("returns") >= least, F.stddev_samp("returns")).alias("vol"))


def decile_membership(ranks: DataFrame, buckets: int = 10) -> DataFrame:
    """Rows of ranks with bucket 1..buckets: stable order, earlier buckets one larger; none where a session has too few."""
    day = Window.partitionBy("k", "t")
    cut = ranks.withColumn("bucket", F.ntile(buckets).over(day.orderBy("r", "inst_idx"))).withColumn("size", F.count("*").over(day))
    return cut.where(F.col("size") >= buckets).drop("size")
