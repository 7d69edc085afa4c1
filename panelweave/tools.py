"""Command-line checks: python -m panelweave.tools {lookahead,deciles,null,gauntlet,momentum} [--root LAYOUT]."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import Expr, from_string, random_tree
from .operators import budget
from .operators.gauntlet import TESTS, Gauntlet
from .operators.null import calibrate
from .operators.portfolio import annualise, compare_monthly, decile_returns, to_monthly
from .plans.compiler import values_of
from .sources.factors import read_monthly_factor
from .sources.panel import LayoutAdapter, snapshot_id
from .sources.synthetic import SyntheticSpec, generate

MOMENTUM = "div(ts_delay(close, 20), ts_delay(close, 250))"
# Limits of the decile control, shapes of planted signals, and signals that find them.
NULL_SPREAD, PLANTED_SPREAD = 0.15, 0.25
PLANTS = {"plain": {}, "fading": {"momentum_decay": 0.36}, "narrow": {"momentum_universe": 0.5}, "rough_only": {"momentum_in_regime": True, "vol_regime": 0.4}}
TRUE_SIGNALS = (MOMENTUM, "div(ts_delay(close, 20), ts_delay(close, 120))", "div(ts_delay(close, 10), ts_delay(close, 250))", f"rank({MOMENTUM})")
PLAIN_STRENGTH, SHAPED_STRENGTH = 0.08, 0.12
SEARCH_SIZES = (100, 1_000, 10_000, 100_000, 1_000_000)


def prefix_differences(panel: DataFrame, trees: list[Expr], cuts: list[int]) -> DataFrame:
    """k, cut, cells where values on the first `cut` sessions differ from the full panel's: must be none."""
    full = values_of(panel, trees)
    out = None
    for cut in cuts:
        part = values_of(panel.where(F.col("t") < cut), trees)
        both = full.where(F.col("t") < cut).alias("a").join(part.alias("b"), ["t", "inst"])
        counts = [F.struct(F.lit(i).alias("k"), F.count_if(~F.col(f"a.v{i}").eqNullSafe(F.col(f"b.v{i}"))).alias("cells")) for i in range(len(trees))]
        one = both.agg(F.array(*counts).alias("x")).select(F.inline("x")).withColumn("cut", F.lit(cut)).where("cells > 0")
        out = one if out is None else out.unionByName(one)
    return out


def check_lookahead(spark: SparkSession, args) -> int:
    rng = np.random.default_rng(args.seed)
    panel = _panel(spark, args, rng).cache()
    n = panel.agg(F.max("t")).first()[0] + 1
    cuts = [c for c in (n // 4, n // 2, n - 1, 251, 260) if 0 < c < n]
    bad = 0
    for at in range(0, args.trees, 20):
        trees = [random_tree(rng, 4) for _ in range(min(20, args.trees - at))]
        for r in prefix_differences(panel, trees, cuts).collect():
            bad += 1
            print(f"{trees[r['k']]} differs in {r['cells']} cells when cut at {r['cut']}")
    print(f"{args.trees} trees, {bad} differences")
    return int(bad > 0)


def check_deciles(spark: SparkSession, args) -> int:
    spreads = {}
    for strength in (0.0, 0.05):
        data = generate(spark, np.random.default_rng(args.seed), SyntheticSpec(n_days=args.days, n_instruments=args.instruments, momentum=strength))
        got = decile_returns(data.panel.df.cache(), from_string(MOMENTUM)).spread.select("t", "date", F.col("spread").alias("ret"))
        spreads[strength] = annualise(got).first()[0]
    print(json.dumps(spreads))
    return int(abs(spreads[0.0] or 0) > NULL_SPREAD or (spreads[0.05] or 0) < PLANTED_SPREAD)


def calibrate_null(spark: SparkSession, args) -> int:
    if args.source != "random_tree":
        print(f"unknown source {args.source}", file=sys.stderr)
        return 2
    rng = np.random.default_rng(args.seed)
    panel = _panel(spark, args, rng).cache()
    from .sources.panel import Panel

    c = calibrate(panel, rng, snapshot_id(Panel(panel)), n_trials=args.trials)
    if args.out:
        c.trials.write.mode("overwrite").parquet(args.out)
    print(json.dumps({k: v for k, v in vars(c).items() if k not in ("trials", "max_abs_ic", "max_ic_ir")} | {"max_abs_ic": asdict(c.max_abs_ic)}, default=str))
    return int(c.leaks)


def calibrate_gauntlet(spark: SparkSession, args) -> int:
    """Size, thresholds, redundancy and power of the statistics, over null trees and planted signals."""
    rng = np.random.default_rng(args.seed)
    spec = lambda **k: SyntheticSpec(n_days=args.days, n_instruments=args.instruments, vol_regime=0.4, **k)
    flat = Gauntlet(generate(spark, rng, spec()).panel.df.cache())
    null = [flat.run(random_tree(rng, 4)).measured for _ in range(args.trials)]
    planted = []
    for shape in PLANTS.values():
        strength = SHAPED_STRENGTH if shape else PLAIN_STRENGTH
        strong = Gauntlet(generate(spark, rng, spec(**({"momentum": strength} | {k: v for k, v in shape.items() if k != "vol_regime"}))).panel.df.cache())
        planted += [strong.run(from_string(t)).measured for t in TRUE_SIGNALS]
    table = lambda rows: spark.createDataFrame([tuple(min(r[t], 1e9) for t in TESTS) for r in rows], ", ".join(f"{t} double" for t in TESTS))
    limits = budget.propose_thresholds(table(null), table(planted), {t: up for t, (up, _) in TESTS.items()})
    passes = lambda r: {t: r[t] >= limits[t] if up else r[t] <= limits[t] for t, (up, _) in TESTS.items()}
    verdicts = spark.createDataFrame([tuple(passes(r).values()) for r in null], ", ".join(f"{t} boolean" for t in TESTS))
    pairs = [r.asDict() for r in budget.redundant_pairs(budget.rejection_correlation(verdicts, list(TESTS))).collect()]
    power = sum(all(passes(r).values()) for r in planted)
    report = {"limits": limits, "null": vars(budget.wilson(sum(all(passes(r).values()) for r in null), len(null))), "planted": vars(budget.wilson(power, len(planted))), "redundant": pairs}
    print(json.dumps(report | survival(spark, [(r["ic_magnitude"], all(v for t, v in passes(r).items() if t != "ic_magnitude")) for r in null], limits["ic_magnitude"]), default=str))
    return 0


def survival(spark: SparkSession, null: list[tuple[float, bool]], tau: float) -> dict:
    """Rates of robust null candidates by magnitude, and the searches that they allow.

    At tau itself too few are left to tell, and the rate rises with magnitude: the highest cut with
    enough candidates bounds it from below, and the search sizes from above.
    """
    samples = spark.createDataFrame(null, "magnitude double, robust boolean").cache()
    cuts = samples.agg(*[F.percentile("magnitude", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]).first().asDict() | {"tau": tau}
    rates = [r.asDict() for r in budget.conditional_pass_rate(samples, "magnitude", "robust", cuts).collect()]
    usable = max((r for r in rates if r["enough"]), key=lambda r: r["level"], default=None)
    if usable is None:
        return {"conditional": rates, "budget": None}
    passed = sum(m >= tau for m, _ in null)
    found = budget.SurvivalBudget(budget.wilson(passed, len(null)), budget.wilson(usable["passes"], usable["n"]))
    return {"conditional": rates, "conditional_at": usable["cut"], "survival": found.survival, "one_survivor_at": found.budget_at(1.0), "expected": found.curve(SEARCH_SIZES)}


def verify_momentum(spark: SparkSession, args) -> int:
    if not args.factor:
        print("a monthly factor file is needed (--factor)", file=sys.stderr)
        return 2
    panel = _panel(spark, args, np.random.default_rng(args.seed)).cache()
    spread = decile_returns(panel, from_string(MOMENTUM)).spread.select("date", F.col("spread").alias("ret"))
    r = compare_monthly(to_monthly(spread), read_monthly_factor(spark, args.factor)).first()
    print(json.dumps(r.asDict()))
    return int(not (r["correlation"] and r["correlation"] > 0.9))


def _panel(spark: SparkSession, args, rng) -> DataFrame:
    if args.root:
        return LayoutAdapter(spark, args.root).panel().df
    return generate(spark, rng, SyntheticSpec(n_days=args.days, n_instruments=args.instruments)).panel.df


def main(argv: list[str] | None = None) -> int:
    commands = {"lookahead": check_lookahead, "deciles": check_deciles, "null": calibrate_null, "gauntlet": calibrate_gauntlet, "momentum": verify_momentum}
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=commands)
    p.add_argument("--root"), p.add_argument("--factor"), p.add_argument("--out")
    p.add_argument("--source", default="random_tree")
    for name, value in (("seed", 7), ("days", 600), ("instruments", 120), ("trees", 500), ("trials", 1000)):
        p.add_argument(f"--{name}", type=int, default=value)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("panelweave").getOrCreate()
    return commands[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
