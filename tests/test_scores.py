"""Metrics, portfolios, identity, null and robustness on panels whose answers are known."""

import math
import random
import sqlite3
import subprocess

import numpy as np
import pytest
from helpers import column, make_panel, table
from pyspark.sql import functions as F

from panelweave.functions.expr import from_string
from panelweave.operators import budget, gauntlet, metrics, null, portfolio
from panelweave.plans import evaluate
from panelweave.plans.ledger import KillReason, Ledger, LedgerError, Stage, Trial, Verdict, git_sha, open_ledger
from panelweave.plans.screen import Screen, ScreenConfig, verdict_of
from panelweave.sources import panel as sources
from panelweave.sources.synthetic import SyntheticSpec, generate


@pytest.fixture(scope="module")
def data(spark):
    return generate(spark, np.random.default_rng(20), SyntheticSpec(n_days=300, n_instruments=45, momentum=0.0))


@pytest.fixture(scope="module")
def panel(data):
    return data.panel.df.cache()


def test_forward_returns(spark):
    one = make_panel(spark, returns=column([0.1, 0.2, 0.3, 0.4]))
    got = table(metrics.forward_returns(one, 1), "fwd")
    assert [got[t, 0] for t in range(4)] == [pytest.approx(x) if x else None for x in (0.2, 0.3, 0.4, None)]
    two = table(metrics.forward_returns(make_panel(spark, returns=column([0.1] * 4)), 2), "fwd")
    assert [two[t, 0] for t in range(4)] == [pytest.approx(0.21), pytest.approx(0.21), None, None]
    with pytest.raises(ValueError):
        metrics.forward_returns(one, 0)


def _ranked(spark, rows):
    return metrics.rank_long(spark.createDataFrame([(0, t, f"I{i}", i, float(v)) for t, row in enumerate(rows) for i, v in enumerate(row)], "k int, t int, inst string, inst_idx int, v double"))


def test_daily_ic_needs_twenty_names(spark):
    same, few = _ranked(spark, [range(40)]), _ranked(spark, [range(5)])
    other = _ranked(spark, [[-x for x in range(40)]])
    as_forward = lambda r: r.select("t", "inst", "inst_idx", F.col("r").alias("fr"))
    assert metrics.daily_rank_ic(same, as_forward(same)).first()["ic"] == pytest.approx(1)
    assert metrics.daily_rank_ic(same, as_forward(other)).first()["ic"] == pytest.approx(-1)
    assert metrics.daily_rank_ic(few, as_forward(few)).count() == 0


def test_turnover_of_still_and_reversed_books(spark):
    grid = make_panel(spark, close=[[1.0] * 30] * 2)
    rename = lambda r: r.withColumn("inst", F.format_string("I%04d", "inst_idx"))
    still, turned = _ranked(spark, [range(30)] * 2), _ranked(spark, [range(30), [-x for x in range(30)]])
    assert metrics.turnover(rename(still), grid, 1).first()["turnover"] == pytest.approx(0)
    assert metrics.turnover(rename(turned), grid, 1).first()["turnover"] == pytest.approx(1)


def test_coverage(spark):
    one = make_panel(spark, close=[[1, None], [2, 3]])
    tree = from_string("abs(close)")
    from panelweave.plans.compiler import values_of

    assert metrics.coverage(values_of(one, [tree]), one, [tree]).first()["coverage"] == 0.75


def test_what_is_known_today_and_tomorrow(spark, panel):
    """Today's return says nothing about tomorrow's here; tomorrow's own return says all."""
    ahead = panel.withColumn("open", F.lead("returns", 1).over(metrics.history()))
    got = {r["k"]: r for r in metrics.summarise(ahead, [from_string("abs(close)"), from_string("add(open, open)"), from_string("sub(returns, open)")]).collect()}
    assert abs(got[0]["ic"]) < 0.05 and got[1]["ic"] > 0.99 and got[1]["n_scored_days"] > 200
    assert 0 < got[0]["coverage"] <= 1 and got[0]["dispersion"] == pytest.approx(0.288, abs=0.02)


def test_summary_equals_its_parts(panel):
    trees = [from_string("ts_mean(returns, 5)"), from_string("delta(close, 5)")]
    got = {r["k"]: r for r in metrics.summarise(panel, trees).collect()}
    ranks = metrics.ranked_signals(panel, trees)
    for r in metrics.turnover(ranks, panel, 2).collect():
        assert got[r["k"]]["turnover"] == pytest.approx(r["turnover"])
    for r in metrics.ic_summary(metrics.daily_rank_ic(ranks, metrics.ranked_forward(panel))).collect():
        assert got[r["k"]]["ic"] == pytest.approx(r["ic"]) and got[r["k"]]["ic_ir"] == pytest.approx(r["ic_ir"])


def test_deciles(spark, panel):
    ranks = _ranked(spark, [range(23)])
    sizes = [r["count"] for r in metrics.decile_membership(ranks).groupBy("bucket").count().orderBy("bucket").collect()]
    assert sizes == [3, 3, 3] + [2] * 7
    assert metrics.decile_membership(_ranked(spark, [range(9)])).count() == 0
    tree = from_string("ts_mean(close, 20)")
    lagged = portfolio.decile_returns(panel, tree).daily.collect()
    now = {(r["t"], r["bucket"]): r["ret"] for r in portfolio.decile_returns(panel, tree, lag=False).daily.collect()}
    compat = {(r["t"], r["bucket"]): r["ret"] for r in portfolio.decile_returns(panel, tree, compat=True).daily.collect()}
    flags = {r["t"]: r["is_rebalance"] for r in portfolio.rebalance_days(panel, tree.warmup).collect()}
    assert sum(flags.values()) >= 10 and min(t for t, f in flags.items() if f) >= tree.warmup
    assert min(r["t"] for r in lagged) == 1 + min(t for t, f in flags.items() if f)
    assert all(compat[t + 1, b] == pytest.approx(v) for (t, b), v in now.items() if (t + 1, b) in compat)
    month = portfolio.to_monthly(portfolio.decile_returns(panel, tree).daily, by=("bucket",))
    assert month.where("bucket = 'market'").count() >= 10


def test_annualise(spark):
    rows = spark.createDataFrame([(0.01,)] * 252 + [(None,)], "ret double")
    assert portfolio.annualise(rows).first()[0] == pytest.approx(1.01**252 - 1)
    assert portfolio.annualise(spark.createDataFrame([(-1.0,)], "ret double")).first()[0] is None


def test_identity_ignores_scale_and_sign(spark, panel):
    texts = ["ts_mean(close, 5)", "log(ts_mean(close, 5))", "add(ts_mean(close, 5), ts_mean(close, 5))", "delta(close, 5)", "sub(ts_delay(close, 5), close)", "ts_mean(close, 10)"]
    ranks = metrics.ranked_signals(panel, [from_string(t) for t in texts], strict=False)
    h = evaluate.value_hashes(ranks, 300, 45)
    assert h[0] == h[1] == h[2] and h[3] == h[4] and len({h[0], h[3], h[5]}) == 3


def test_orientation_signs(spark):
    low_first = _ranked(spark, [[1, 1, 0, 2]]).where("inst_idx >= 2")
    assert evaluate.orientation(low_first).first()["sign"] == -1
    assert evaluate.orientation(_ranked(spark, [[5, 5, 5]])).first()["sign"] == 1


# --- ledger and screen -----------------------------------------------------------------------


def trial(run, **k):
    return Trial(run, "h" * 32, "abs(close)", Verdict.KILLED, Stage.SCREENED, **({"kill_reason": KillReason.LOW_IC} | k))


def test_ledger_is_append_only(tmp_path, spark):
    with open_ledger(tmp_path / "l.db") as ledger:
        run = ledger.start_run({"seed": 1}, "snap")
        assert ledger.run(run).config["seed"] == 1 and ledger.run(run).config["min_group_size"] == 5
        first = ledger.log_trial(trial(run))
        assert ledger.trial_count(run) == 1 and ledger.has_expr(run, "h" * 32) and ledger.kill_counts(run) == {"low_ic": 1}
        for sql in ("UPDATE trials SET ic = 1", "DELETE FROM trials", "UPDATE runs SET git_sha = ''", "DELETE FROM runs"):
            with pytest.raises(Exception, match="append-only"):
                ledger.db.execute(sql)
        with pytest.raises(ValueError):
            ledger.accept(first)
        good = ledger.log_trial(Trial(run, "g" * 32, "log(close)", Verdict.ACCEPTED, Stage.ACCEPTED))
        assert ledger.accept(good, 0.01).trial_id == good
        with pytest.raises(ValueError):
            ledger.accept(good)
        assert [e.trial_id for e in ledger.pool_entries(run)] == [good]
        assert ledger.trials(spark, run).count() == 2
        with pytest.raises(ValueError, match="min_periods_fraction"):
            ledger.start_run({"min_periods_fraction": 1})
    with pytest.raises(ValueError):
        trial("x", kill_reason=None)
    with pytest.raises(ValueError):
        Trial("x", "h", "e", Verdict.PASSED, Stage.SCREENED, KillReason.LOW_IC)


def test_old_ledger_is_refused(tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "old.db")
    db.execute("CREATE TABLE trials (id INTEGER)")
    db.commit()
    with pytest.raises(LedgerError):
        Ledger(tmp_path / "old.db")


def test_screen_logs_each_hypothesis_once(tmp_path, panel):
    with open_ledger(tmp_path / "s.db") as ledger:
        run = ledger.start_run({})
        config = ScreenConfig(min_scored_days=100, min_abs_ic=0.0, min_ic_ir=0.0, max_turnover=2.0)
        screen = Screen(panel, ledger, run, config)
        texts = ["ts_mean(close, 5)", "rank(ts_mean(close, 5))", "log(ts_mean(close, 5))", "ts_mean(close, 5)", "ts_mean(close, 250)", "sign(close)"]
        out = screen.screen_all([from_string(t) for t in texts])
        assert [o.reason for o in out] == [None, KillReason.DUPLICATE, KillReason.DUPLICATE, KillReason.DUPLICATE, KillReason.LOW_COVERAGE, KillReason.DEGENERATE]
        assert ledger.trial_count(run) == 3 and screen.report.semantic_collapses == 2 and screen.report.structural_duplicates == 1 and screen.report.elided_nodes == 1
        again = Screen(panel, ledger, run, config)
        assert again.screen(from_string("ts_mean(close, 5)")).reason is KillReason.DUPLICATE and ledger.trial_count(run) == 3


def test_verdict_order():
    good = {"coverage": 0.9, "degradation": 0.1, "dispersion": 0.2, "n_scored_days": 300, "ic": 0.05, "ic_ir": 1.0, "turnover": 0.1}
    config = ScreenConfig(min_abs_ic=0.02)
    assert verdict_of(good, config) is None
    for change, reason in (({"coverage": 0.1}, "low_coverage"), ({"degradation": 0.9}, "low_coverage"), ({"dispersion": 0.0}, "degenerate"), ({"n_scored_days": 9}, "low_coverage"), ({"ic": 0.01}, "low_ic"), ({"ic_ir": None}, "low_ic"), ({"turnover": 0.9}, "high_turnover")):
        assert verdict_of(good | change, config).value == reason


# --- null, robustness, budget ----------------------------------------------------------------


def test_permutation_is_a_bijection_per_block(spark, panel):
    names = panel.select("inst_idx").distinct()
    labels = null.block_label_permutation(names, 300, 40, 5).cache()
    size = names.count()
    for r in labels.groupBy("block").agg(F.countDistinct("inst_idx").alias("a"), F.countDistinct("src").alias("b"), F.count("*").alias("n")).collect():
        assert r["a"] == r["b"] == r["n"] == size
    assert labels.count() == 8 * size
    one = lambda s: {tuple(r) for r in null.block_label_permutation(names, 300, 40, s).collect()}
    assert one(5) == one(5) != one(6)
    for days, block in ((0, 2), (10, 0), (10, 11)):
        with pytest.raises(ValueError):
            null.block_label_permutation(names, days, block, 1)


def test_calibration_is_centred_and_bound(panel):
    rng = np.random.default_rng(4)
    draw = lambda r: from_string(f"{['ts_mean', 'ts_std', 'delta', 'ts_rank'][r.integers(4)]}({['close', 'volume', 'returns'][r.integers(3)]}, {[5, 10, 20][r.integers(3)]})")
    c = null.calibrate(panel, rng, "snap", source=draw, n_trials=120, min_scored_days=100, batch=60)
    assert c.n_trials >= 100 and not c.leaks and 0 < c.abs_ic_quantiles["p50"] < c.tau <= c.abs_ic_quantiles["max"]
    assert c.max_abs_ic.sizes[0] == 10 and c.max_abs_ic.expected_at(10) == c.max_abs_ic.mean[0]
    with pytest.raises(ValueError):
        c.max_abs_ic.expected_at(10**6)
    c.assert_applies_to("snap", 1)
    for args, word in ((("other", 1), "dataset"), (("snap", 2), "horizon")):
        with pytest.raises(null.CalibrationMismatch, match=word):
            c.assert_applies_to(*args)
    assert ScreenConfig.from_calibration(c).min_abs_ic == c.tau


def test_folds():
    folds = gauntlet.purged_folds(1400, warmup=20, horizon=1)
    assert len(folds) == 5 and folds[0].start == 20 and all(b.start - a.stop == 21 for a, b in zip(folds, folds[1:], strict=False)) and folds[-1].stop <= 1399
    assert len(gauntlet.purged_folds(300, warmup=20)) == 2 and gauntlet.purged_folds(100, warmup=20) == ()
    with pytest.raises(ValueError):
        gauntlet.purged_folds(0, warmup=1)


def test_statistics_of_a_perfect_signal(panel):
    ahead = panel.withColumn("open", F.lead("returns", 1).over(metrics.history()))
    got = gauntlet.Gauntlet(ahead, n_folds=2).run(from_string("ts_mean(open, 2)"))
    m = got.measured
    assert m["ic_magnitude"] > 0.5 and m["fold_sign"] == 1 and 0.5 < m["fold_ic"] <= 1.01 and m["regime_sign"] == 1 and 0.5 < m["breadth"] <= 1
    assert not got.judged
    with pytest.raises(gauntlet.NotCalibrated):
        got.passed  # noqa: B018
    limits = gauntlet.HISTORY[-1].thresholds
    assert limits.unset() == () and gauntlet.judge("ic_magnitude", 0.5, limits).passed and not gauntlet.judge("jitter_sign", 2, limits).passed


def test_delay_shapes():
    assert gauntlet.delay_shape({0: 0.05, 1: 0.04, 2: 0.03}) == pytest.approx(1)
    assert gauntlet.delay_shape({0: 0.05, 1: 0.0, 2: 0.0}) == pytest.approx(1) and math.isinf(gauntlet.delay_shape({0: 0.05, 1: None, 2: 0.1}))


def test_regimes(spark):
    rows = [(t, v) for t, v in enumerate([1, 5, 2, 8, 3, 9])]
    wide = make_panel(spark, returns=[[v * (i - 15) / 100 for i in range(31)] for _, v in rows])
    ics = spark.createDataFrame([(t, float(t)) for t, _ in rows], "t int, ic double")
    got = {r["regime"]: r["ic"] for r in gauntlet.regime_ics(ics, wide).collect()}
    assert got == {"calm": 2.0, "rough": 3.0}


def test_budget(spark):
    r = budget.wilson(0, 3)
    assert r.low == 0 and r.high > 0.4 and budget.wilson(3, 3).high == 1 and budget.wilson(1, 2).estimate == 0.5
    b = budget.SurvivalBudget(budget.wilson(10, 1000), budget.wilson(5, 10))
    assert b.survival[0] == pytest.approx(0.005) and b.budget_at(1)[0] == pytest.approx(200) and b.budget_at(1)[1] <= 200 <= b.budget_at(1)[2]
    low, high = budget.wilson_columns(F.lit(3), F.lit(10))
    got, want = spark.range(1).select(low.alias("l"), high.alias("h")).first(), budget.wilson(3, 10)
    assert got["l"] == pytest.approx(want.low) and got["h"] == pytest.approx(want.high)
    verdicts = spark.createDataFrame([(True, True, True), (False, False, True), (True, True, True), (False, False, True)], "a boolean, b boolean, c boolean")
    rho = {(r["a"], r["b"]): r["rho"] for r in budget.rejection_correlation(verdicts, ["a", "b", "c"]).collect()}
    assert rho["a", "b"] == pytest.approx(1) and rho["a", "c"] is None and rho["c", "c"] == 1
    assert [(r["a"], r["b"]) for r in budget.redundant_pairs(budget.rejection_correlation(verdicts, ["a", "b", "c"])).collect()] == [("a", "b")]


# --- sources ---------------------------------------------------------------------------------


def test_layout_round_trip(spark, data, tmp_path):
    root = data.write(str(tmp_path / "layout"))
    adapter = sources.LayoutAdapter(spark, root)
    back = adapter.panel()
    a = {(r["t"], r["inst"]): (r["close"], r["is_listed"], r["sector"]) for r in data.panel.df.collect()}
    for r in back.df.collect():
        close, listed, sector = a[r["t"], r["inst"]]
        assert r["is_listed"] == listed and r["sector"] == sector and (r["close"] is None) == (close is None)
        assert close is None or r["close"] == pytest.approx(close, rel=1e-6)
    assert adapter.costs().commission_bps == 1.0 and adapter.calendar().count() == 300
    d = adapter.diagnostics(back).first()
    assert d["n_delisted"] > 0 and 0 < d["listed_share"] < 1
    part = adapter.panel("2015-03-01", "2015-06-30")
    assert part.shape()[0] == 87
    plan = adapter.bars("2015-03-01", "2015-06-30")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert back.problems().count() == 0
    with pytest.raises(sources.PanelError, match="after the end"):
        adapter.panel("2016-01-01", "2015-01-01")
    with pytest.raises(sources.PanelError, match="no bars"):
        adapter.panel("2030-01-01", "2030-02-01")
    with pytest.raises(sources.LayoutError):
        sources.LayoutAdapter(spark, str(tmp_path / "nothing")).panel()


def test_faulty_layouts(spark, data, tmp_path):
    from panelweave.sources.panel import LayoutAdapter, PanelError

    root = data.write(str(tmp_path / "l"))
    bars = spark.read.parquet(f"{root}/bars").drop("year")
    spark.createDataFrame(bars.limit(1).collect(), bars.schema).write.mode("append").parquet(f"{root}/bars/year=2015")
    with pytest.raises(PanelError, match="duplicate"):
        LayoutAdapter(spark, root).panel()
    other = data.write(str(tmp_path / "m"))
    spark.createDataFrame([], "date date, is_half boolean").write.mode("overwrite").parquet(f"{other}/calendar/sessions.parquet")
    with pytest.raises(PanelError, match="not trading sessions"):
        LayoutAdapter(spark, other).panel()
    third = data.write(str(tmp_path / "n"))
    spark.createDataFrame([], "instrument_id string, date date, commission_bps double, half_spread_bps double, impact_coef double").write.mode("overwrite").parquet(f"{third}/costs/costs.parquet")
    with pytest.raises(PanelError, match="no default row"):
        LayoutAdapter(spark, third).costs()


def test_delistings(spark):
    import datetime

    grid = make_panel(spark, returns=[[0.1, 0.1, 0.1]] * 4).withColumn("is_listed", F.when((F.col("inst_idx") == 0) & (F.col("t") > 1), 0.0).otherwise(1.0))
    grid = grid.withColumn("returns", F.when(F.col("is_listed") == 1, F.col("returns")))
    day = lambda t: datetime.date(2020, 1, 1) + datetime.timedelta(days=t)
    gone = spark.createDataFrame([("I0000", day(2), -0.5), ("I0001", day(30), -0.5)], "instrument_id string, delist_date date, delist_return double")
    got = table(sources.compose_delistings(grid, gone), "returns")
    assert got[1, 0] == pytest.approx(1.1 * 0.5 - 1) and got[0, 0] == pytest.approx(0.1) and got[3, 1] == pytest.approx(0.1)
    late = spark.createDataFrame([("I0002", day(1), -0.5)], "instrument_id string, delist_date date, delist_return double")
    with pytest.raises(sources.PanelError, match="after its delisting"):
        sources.compose_delistings(grid, late)


def test_panel_invariants_and_snapshot(spark, panel, tmp_path):
    one = sources.Panel(panel)
    one.validate()
    with pytest.raises(sources.PanelError, match="missing fields"):
        sources.Panel(panel.drop("open")).validate()
    with pytest.raises(sources.PanelError, match="unknown"):
        sources.Panel(panel.withColumn("colour", F.lit(1.0))).validate()
    with pytest.raises(sources.PanelError, match="infinity"):
        sources.Panel(panel.withColumn("open", F.lit(float("inf")))).validate()
    with pytest.raises(sources.PanelError, match="relist"):
        sources.Panel(panel.withColumn("is_listed", F.when(F.col("t") == 150, 0.0).otherwise(1.0)).withColumns({c: F.lit(None).cast("double") for c in sources.PRICE_FIELDS})).validate()
    name = sources.snapshot_id(one)
    assert name == sources.snapshot_id(sources.Panel(panel.repartition(7))) != sources.snapshot_id(one.head(299))
    path = sources.write_cache(one, str(tmp_path / "cache"))
    assert sources.snapshot_id(sources.read_cache(spark, path)) == name
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(sources.PanelError):
        sources.read_cache(spark, str(tmp_path / "x"))


def test_costs(spark):
    model = sources.CostModel(1.0, 2.5, 10.0)
    rows = spark.createDataFrame([(0.0,), (0.04,), (None,)], "rate double")
    assert [r[0] for r in rows.select(model.trade_cost_bps("rate")).collect()] == [3.5, 5.5, None]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-0.1,)], "rate double").select(model.trade_cost_bps("rate")).collect()


def test_factor_file(spark, tmp_path):
    from panelweave.sources.factors import read_monthly_factor

    (tmp_path / "f.csv").write_text("Made up\n\n,Mom\n192701,  1.50\n192702, -2.00\n\nAnnual\n1927, 5.0\n")
    assert [(str(r["month"]), r["factor"]) for r in read_monthly_factor(spark, str(tmp_path / "f.csv")).orderBy("month").collect()] == [("1927-01-01", 0.015), ("1927-02-01", -0.02)]


def test_settings(monkeypatch):
    import io
    import json
    import logging

    from panelweave import settings

    s = settings.Secret("hush")
    assert "hush" not in f"{s}{s!r}{s:>20}" and s.reveal() == "hush"
    monkeypatch.delenv("PW_KEY", raising=False)
    with pytest.raises(settings.MissingCredential):
        settings.require("PW_KEY")
    assert settings.optional_setting("PW_KEY", "x") == "x"
    out = io.StringIO()
    settings.configure_logging(stream=out)
    logging.getLogger("panelweave.x").info("hello", extra={"n": 3})
    assert json.loads(out.getvalue())["n"] == 3


def test_lookahead_tool(panel):
    from panelweave.tools import prefix_differences

    trees = [from_string(t) for t in ("zscore(ts_mean(close, 10))", "ts_mean(rank(volume), 5)", "demean_by(returns, sector)")]
    assert prefix_differences(panel, trees, [100, 299]).count() == 0
    peeking = panel.withColumn("open", F.lead("close", 1).over(metrics.history()))
    # A field that already looks ahead can't be caught; a panel cut before the field is made can.
    assert prefix_differences(peeking, [from_string("abs(open)")], [100]).count() == 0


def test_credentials(monkeypatch):
    from panelweave.settings import DataCredentials, MissingCredential

    monkeypatch.delenv("PANELWEAVE_DATA_KEY", raising=False)
    with pytest.raises(MissingCredential):
        DataCredentials()
    monkeypatch.setenv("PANELWEAVE_DATA_KEY", "k")
    monkeypatch.setenv("PANELWEAVE_DATA_SECRET", "hush")
    assert "hush" not in repr(DataCredentials())


def test_ledger_keeps_what_it_is_told(tmp_path):
    with open_ledger(tmp_path / "ledger.sqlite") as ledger:
        runs = [ledger.start_run({}) for _ in range(5)]
        assert runs == sorted(runs) and len(set(runs)) == 5
        ledger.log_trial(trial(runs[0], kill_reason="borrow_unavailable"))
        ledger.log_trial(trial(runs[0], kill_reason=KillReason.REDUNDANT))
        assert ledger.kill_counts(runs[0]) == {"borrow_unavailable": 1, "redundant": 1}
        kept = ledger.log_trial(Trial(runs[0], "g" * 32, "log(close)", Verdict.ACCEPTED, Stage.POOL))
        ledger.accept(kept, 0.01)
        for statement in ("UPDATE pool SET incremental_ic = 0.9", "DELETE FROM pool"):
            with pytest.raises(sqlite3.IntegrityError, match="append-only"):
                ledger.db.execute(statement)
        with pytest.raises(KeyError):
            ledger.run("none such")
        assert Stage.POOL.value == "pool"


def test_a_dirty_tree_is_marked(tmp_path):
    assert git_sha(tmp_path) is None or not git_sha(tmp_path).startswith("#")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init")
    assert git_sha(tmp_path) is None
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-m", "a")
    clean = git_sha(tmp_path)
    assert len(clean) == 40
    (tmp_path / "b").write_text("1")
    assert git_sha(tmp_path) == clean + "-dirty"


def test_one_bad_candidate_does_not_take_its_batch_along(panel, tmp_path, monkeypatch):
    from panelweave.plans import screen as module

    plain = module.measure
    monkeypatch.setattr(module, "measure", lambda grid, trees, *a: (_ for _ in ()).throw(ArithmeticError("no")) if any("mul" in str(t) for t in trees) else plain(grid, trees, *a))
    with open_ledger(tmp_path / "ledger.sqlite") as ledger:
        run = ledger.start_run({})
        limits = ScreenConfig(min_scored_days=1, min_abs_ic=0.0, min_ic_ir=0.0, max_turnover=9.0, min_coverage=0.0, min_dispersion=0.0, max_degradation=1.0)
        out = Screen(panel, ledger, run, limits).screen_all([from_string(t) for t in ("close", "mul(close, volume)", "volume")])
        assert [o.reason for o in out][1] is KillReason.ERROR and KillReason.ERROR not in (out[0].reason, out[2].reason)
        assert ledger.trial_count(run) == 3 and ScreenConfig().min_abs_ic == 0.005


def test_a_gauntlet_refuses_a_foreign_calibration(panel):
    class Calibration:
        tau = 0.02

        def assert_applies_to(self, snapshot, horizon):
            if (snapshot, horizon) != ("own", 1):
                raise null.CalibrationMismatch("another panel")

    with pytest.raises(null.CalibrationMismatch):
        gauntlet.Gauntlet(panel, calibration=Calibration(), snapshot="other")
    assert gauntlet.Gauntlet(panel, calibration=Calibration(), snapshot="own").thresholds.min_abs_ic == 0.02
    with pytest.raises(ValueError):
        gauntlet.Gauntlet(panel, gauntlet.Thresholds(min_abs_ic=0.5), calibration=Calibration(), snapshot="own")


def test_every_decision_says_why_and_what_is_wrong():
    assert [d.version for d in gauntlet.HISTORY] == list(range(1, len(gauntlet.HISTORY) + 1)) and gauntlet.CURRENT is gauntlet.HISTORY[-1]
    assert all(min(len(d.reason), len(d.measured), len(d.limitations)) > 40 and d.dated and d.data_snapshot_id for d in gauntlet.HISTORY)


def test_turnover_equals_the_dense_definition(spark):
    """Books that come, go and skip sessions, against weights on the whole grid."""
    rnd = random.Random(2)
    cells = {(k, t, i): rnd.uniform(-1, 1) for k in range(2) for t in range(9) for i in range(6) if rnd.random() < 0.6 and (k or t > 2)}
    panel = spark.createDataFrame([(t, str(i)) for t in range(9) for i in range(6)], "t int, inst string")
    ranks = spark.createDataFrame([(k, t, str(i), r) for (k, t, i), r in cells.items()], "k int, t int, inst string, r double")
    gross = {}
    for (k, t, _), r in cells.items():
        gross[k, t] = gross.get((k, t), 0) + abs(r)
    w = lambda k, t, i: cells.get((k, t, i), 0.0) / gross.get((k, t), 1)
    want = {k: sum(abs(w(k, t, i) - w(k, t - 1, i)) for t in range(1, 9) for i in range(6)) / 2 / 8 for k in range(2)} | {2: 0.0}
    got = {r["k"]: r["turnover"] for r in metrics.turnover(ranks, panel, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_survival_takes_the_highest_cut_with_enough_candidates(spark):
    from panelweave import tools

    null_rows = [(i / 1000, i % 4 == 0) for i in range(1000)]
    got = tools.survival(spark, null_rows, 0.999)
    rates = {r["cut"]: r for r in got["conditional"]}
    assert rates["p50"]["n"] == 500 and rates["tau"]["n"] == 1 and not rates["tau"]["enough"] and not rates["p99"]["enough"]
    assert got["conditional_at"] == "p90" and got["survival"][0] == pytest.approx(0.001 * rates["p90"]["passes"] / rates["p90"]["n"])
    assert [n for n, *_ in got["expected"]] == list(tools.SEARCH_SIZES) and tools.survival(spark, null_rows[:5], 1.0)["budget"] is None
    assert len(tools.TRUE_SIGNALS) == 4 and all(from_string(t) for t in tools.TRUE_SIGNALS)
