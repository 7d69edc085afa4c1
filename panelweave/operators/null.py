"""Null calibration: scores of candidates against forward ranks whose labels are shuffled by block of sessions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Expr, grammar_fingerprint, random_tree, strip_elidable_root
from .metrics import ranked_forward, summarise

# Fixed values.
DEFAULT_BLOCK = 40
LEAK_SIGMAS = 4.0
BATCH_LADDER = (10, 32, 100, 316, 1000, 3162, 10000, 31623)
MIN_BATCHES = 8
MIN_TRIALS = 100


class CalibrationMismatch(RuntimeError):
    """A calibration was used on data, a grammar or a horizon it wasn't made for."""


def block_label_permutation(instruments: DataFrame, n_days: int, block_length: int, seed: int | Column = 0, trials: DataFrame | None = None) -> DataFrame:
    """block, inst_idx, src (and k): per block of sessions a permutation of the instruments.

    instruments: inst_idx. Both orders are by hash, so their pairing is a bijection in every block
    and depends on the seed alone. trials: k, to draw one permutation for each trial.
    """
    if n_days <= 0 or not 1 <= block_length <= n_days:
        raise ValueError(f"the block length {block_length} must lie in 1..{n_days}")
    blocks = instruments.sparkSession.range(-(-n_days // block_length)).select(F.col("id").cast("int").alias("block"))
    keys = ["block"]
    base = blocks.crossJoin(instruments.select("inst_idx").distinct())
    if trials is not None:
        base, keys = base.crossJoin(trials.select("k")), ["k", "block"]
    salt = [F.lit(seed) if isinstance(seed, int) else seed, *[F.col(k) for k in keys]]
    place = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ordered = base.withColumn("at", place([F.col("inst_idx")]))
    mixed = base.select(*keys, F.col("inst_idx").alias("src"), place([F.md5(F.concat_ws(":", F.col("inst_idx").cast("string"), *[s.cast("string") for s in salt])), F.col("inst_idx")]).alias("at"))
    return ordered.join(mixed, [*keys, "at"]).select(*keys, "inst_idx", "src")


def permuted_forward(forward: DataFrame, labels: DataFrame, block_length: int) -> DataFrame:
    """Forward ranks under other labels: (k,) t, inst_idx, fr."""
    rows = forward.select("t", F.floor(F.col("t") / block_length).cast("int").alias("block"), F.col("inst_idx").alias("src"), "fr")
    return rows.join(labels, ["block", "src"]).drop("block", "src")


@dataclass(frozen=True)
class MaximumCurve:
    """Distribution of the largest of `size` trials, from disjoint batches."""

    sizes: tuple[int, ...] = ()
    mean: tuple[float, ...] = ()
    p50: tuple[float, ...] = ()
    p95: tuple[float, ...] = ()
    largest: tuple[float, ...] = ()
    n_batches: tuple[int, ...] = ()

    def expected_at(self, search_size: int) -> float:
        """Mean maximum at a search size, between measured sizes by their logarithm; beyond them it isn't known."""
        if not self.sizes:
            raise ValueError("no curve was measured")
        if not self.sizes[0] <= search_size <= self.sizes[-1]:
            raise ValueError(f"search size {search_size} lies outside the measured {self.sizes[0]}..{self.sizes[-1]}")
        return float(np.interp(math.log(search_size), np.log(self.sizes), self.mean))


def maximum_curve(trials: DataFrame, value: str, ladder: tuple[int, ...] = BATCH_LADDER) -> DataFrame:
    """size, mean, p50, p95, largest, n_batches of batch maxima.

    trials: trial (0, 1, ... without gaps) and a value. A last batch that isn't full is left out, and
    so are sizes with fewer than MIN_BATCHES batches.
    """
    sizes = F.explode(F.array(*map(F.lit, ladder))).alias("size")
    total = trials.agg(F.count("*").alias("total"))
    rows = trials.crossJoin(F.broadcast(total)).select("trial", F.col(value).alias("v"), "total", sizes)
    full = rows.where(F.col("trial") < F.floor(F.col("total") / F.col("size")) * F.col("size"))
    maxima = full.groupBy("size", F.floor(F.col("trial") / F.col("size")).alias("batch")).agg(F.max("v").alias("m"))
    q = lambda p: F.percentile("m", F.lit(p))
    out = maxima.groupBy("size").agg(F.avg("m").alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("m").alias("largest"), F.count("*").alias("n_batches"))
    return out.where(F.col("n_batches") >= MIN_BATCHES)


def null_quantiles(trials: DataFrame, value: str = "abs_ic", admit_fraction: float = 0.001) -> DataFrame:
    """p50, p75, p90, p95, p99, p999, max and tau (the quantile that admits `admit_fraction`)."""
    at = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999, "tau": 1 - admit_fraction}
    return trials.agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in at.items()], F.max(value).alias("max"))


def null_moments(trials: DataFrame) -> DataFrame:
    """sigma_sr, mean_ic, standard_error, leaks, n_trials from signed ic and ic_ir."""
    error = F.stddev_samp("ic") / F.sqrt(F.count("ic"))
    return trials.agg(
        F.stddev_samp("ic_ir").alias("sigma_sr"), F.avg("ic").alias("mean_ic"), error.alias("standard_error"),
        F.coalesce((error > 0) & (F.abs(F.avg("ic")) > LEAK_SIGMAS * error), F.lit(False)).alias("leaks"), F.count("*").alias("n_trials"),
    )


@dataclass(frozen=True)
class NullCalibration:
    data_snapshot_id: str
    grammar_fingerprint: str
    block_length: int
    horizon: int
    source_name: str
    panel_shape: tuple[int, int]
    n_trials: int
    abs_ic_quantiles: dict[str, float]
    tau: float
    tau_quantile: float
    sigma_sr: float | None
    mean_ic: float
    mean_ic_standard_error: float
    leaks: bool
    median_scored_days: float
    max_abs_ic: MaximumCurve
    max_ic_ir: MaximumCurve
    trials: DataFrame = field(repr=False, compare=False, default=None)

    @property
    def leak_sigmas(self) -> float:
        return abs(self.mean_ic) / self.mean_ic_standard_error if self.mean_ic_standard_error else 0.0

    def analytic_max_ic_ir(self, search_size: int) -> float:
        """sigma sqrt(2 ln N): advisory only, the measured curve lies below it."""
        if search_size < 2:
            raise ValueError("a maximum needs two trials or more")
        return self.sigma_sr * math.sqrt(2 * math.log(search_size))

    def binding(self) -> dict[str, object]:
        """What a run that relies on this calibration records."""
        return {"null_tau": self.tau, "null_snapshot": self.data_snapshot_id, "null_grammar": self.grammar_fingerprint, "null_horizon": self.horizon, "null_block": self.block_length, "null_source": self.source_name}

    def assert_applies_to(self, snapshot: str, horizon: int) -> None:
        if snapshot != self.data_snapshot_id:
            raise CalibrationMismatch("calibrated on a different dataset")
        if horizon != self.horizon:
            raise CalibrationMismatch("calibrated for a different horizon")
        if grammar_fingerprint() != self.grammar_fingerprint:
            raise CalibrationMismatch("calibrated under a different grammar")


def _curve(trials: DataFrame, value: str) -> MaximumCurve:
    rows = maximum_curve(trials, value).orderBy("size").collect()
    return MaximumCurve(*(tuple(r[c] for r in rows) for c in ("size", "mean", "p50", "p95", "largest", "n_batches")))


def calibrate(
    panel: DataFrame, rng: np.random.Generator, snapshot: str, *, source: Callable[[np.random.Generator], Expr] | None = None, source_name: str | None = None, n_trials: int = 10_000,
    max_depth: int = 4, block_length: int = DEFAULT_BLOCK, horizon: int = 1, admit_fraction: float = 0.001, min_dispersion: float = 0.01, min_scored_days: int = 250, batch: int = 24,
) -> NullCalibration:
    """Score candidates against relabelled forward ranks, a batch of trees in each plan.

    Every trial draws its own tree and its own permutation. Trials that a screen would refuse
    (flat, unscored, too few days) don't count. `source` must be what the search itself draws from.
    """
    spark, draw = panel.sparkSession, source or (lambda r: random_tree(r, max_depth))
    forward = ranked_forward(panel, horizon).cache()
    n_days, n_inst = (lambda r: (r[0] + 1, r[1]))(panel.agg(F.max("t"), F.countDistinct("inst")).first())
    names = panel.select("inst", "inst_idx").distinct()
    kept: list[tuple] = []
    for at in range(0, n_trials, batch):
        trees = [strip_elidable_root(draw(rng))[0] for _ in range(min(batch, n_trials - at))]
        seeds = spark.range(len(trees)).select(F.col("id").cast("int").alias("k"))
        labels = block_label_permutation(names, n_days, block_length, int(rng.integers(2**31)), seeds)
        shuffled = permuted_forward(forward, labels, block_length).join(names, "inst_idx")
        for r in _measured(panel, trees, shuffled).collect():
            if r["dispersion"] >= min_dispersion and r["ic"] is not None and math.isfinite(r["ic"]) and r["n_scored_days"] >= min_scored_days:
                kept.append((len(kept), abs(r["ic"]), r["ic"], r["ic_ir"], r["n_scored_days"]))
    forward.unpersist()
    if len(kept) < MIN_TRIALS:
        raise RuntimeError(f"only {len(kept)} of {n_trials} trials can be used; {MIN_TRIALS} are needed")
    trials = spark.createDataFrame(kept, "trial long, abs_ic double, ic double, ic_ir double, n_scored_days long").cache()
    q, m = null_quantiles(trials, "abs_ic", admit_fraction).first().asDict(), null_moments(trials).first()
    ratios = trials.where("ic_ir IS NOT NULL").withColumn("trial", F.row_number().over(Window.orderBy("trial")) - 1).withColumn("abs_ir", F.abs("ic_ir"))
    return NullCalibration(
        snapshot, grammar_fingerprint(), block_length, horizon, source_name or getattr(source, "__name__", "random_tree"), (n_days, n_inst), len(kept),
        {k: v for k, v in q.items() if k != "tau"}, q["tau"], 1 - admit_fraction, m["sigma_sr"], m["mean_ic"], m["standard_error"], m["leaks"],
        trials.agg(F.median("n_scored_days")).first()[0], _curve(trials, "abs_ic"), _curve(ratios, "abs_ir"), trials,
    )


def _measured(panel: DataFrame, trees: list[Expr], forward: DataFrame) -> DataFrame:
    """summarise() with forward ranks of its own for each tree."""
    from .metrics import MIN_CROSS_SECTION, dispersion, ic_summary, pair_correlation, ranked_signals

    ranks = ranked_signals(panel, trees)
    pairs = ranks.join(forward.select("k", "t", "inst", "fr"), ["k", "t", "inst"])
    days = pairs.groupBy("k", "t").agg(F.count("*").alias("n"), pair_correlation(F.col("r"), F.col("fr")).alias("ic"))
    return ic_summary(days.where((F.col("n") >= MIN_CROSS_SECTION) & F.col("ic").isNotNull())).join(dispersion(ranks), "k")


__all__ = ["CalibrationMismatch", "MaximumCurve", "NullCalibration", "block_label_permutation", "calibrate", "maximum_curve", "null_moments", "null_quantiles", "permuted_forward", "summarise"]
