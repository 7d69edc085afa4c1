"""Registered queries: every operator over the weekly panel of the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions.expr import Expr, from_string, jittered
from .operators import budget, gauntlet, metrics, null, portfolio
from .plans import evaluate
from .plans.compiler import values_of
from .plans.ledger import Stage, Trial, Verdict, open_ledger
from .plans.screen import Screen, ScreenConfig, measure, verdict_of
from .sources import panel as sources

Query = Callable[[SparkSession, str], DataFrame]

#: Each operator once, and nested trees; names are those of the queries.
EXPRESSIONS = {
    "op_add": "add(close, open)",
    "op_sub": "sub(close, open)",
    "op_mul": "mul(close, returns)",
    "op_div": "div(close, open)",
    "op_log": "log(close)",
    "op_abs": "abs(returns)",
    "op_sign": "sign(returns)",
    "op_ts_delay": "ts_delay(close, 5)",
    "op_delta": "delta(close, 5)",
    "op_ts_mean": "ts_mean(close, 20)",
    "op_ts_std": "ts_std(close, 20)",
    "op_ts_min": "ts_min(close, 20)",
    "op_ts_max": "ts_max(high, 60)",
    "op_ts_argmax": "ts_argmax(close, 10)",
    "op_ts_rank": "ts_rank(close, 20)",
    "op_decay_linear": "decay_linear(close, 10)",
    "op_correlation": "correlation(close, volume, 20)",
    "op_rank": "rank(close)",
    "op_zscore": "zscore(close)",
    "op_demean_by": "demean_by(close, sector)",
    "op_rank_within": "rank_within(close, sector)",
    "tree_momentum": "div(ts_delay(close, 20), ts_delay(close, 250))",
    "tree_nested_mean": "ts_mean(ts_mean(close, 20), 60)",
    "tree_corr_of_ranks": "correlation(rank(close), rank(volume), 20)",
    "tree_rank_change": "delta(rank(ts_mean(close, 5)), 10)",
    "tree_neutral": "ts_rank(demean_by(log(close), sector), 10)",
}
#: The signals that scores are computed for.
SIGNALS = ["ts_mean(close, 20)", "delta(close, 5)", "sub(close, open)", "ts_rank(close, 10)"]
MOMENTUM = "div(ts_delay(close, 20), ts_delay(close, 60))"


_PANELS: dict[tuple[str, str], DataFrame] = {}


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder's panel, cached once for a Spark application (cache() again is free, and needed after clearCache)."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _PANELS:
        _PANELS[key] = sources.weekly_panel(spark, sf_dir).df
    return _PANELS[key].cache()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a local session without spark.checkpoint.dir may use a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _whole(panel: DataFrame) -> DataFrame:
    """The panel with every field of a layout: those that the tables lack are constant or follow the instrument's number."""
    made = {"adj_factor": F.lit(1.0), "lot_size": F.lit(1.0), "can_short": F.lit(1.0), "halted": (F.col("inst_idx") % 7 == 0).cast("double"), "surveillance_flag": F.lit(0.0)}
    rest = [f for f in sources.FIELDS if f not in panel.columns and f not in made]
    return panel.withColumns(made | {f: F.lit(None).cast("double") for f in rest})


def _r(c, digits: int = 6):
    return sources.nudged(F.col(c) if isinstance(c, str) else c, digits)


def _values(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values_of(_panel(spark, sf_dir), [from_string(text)]).where("v0 IS NOT NULL").select("t", "inst", _r("v0").alias("v"))

    return query


def _trees() -> list[Expr]:
    return [from_string(t) for t in SIGNALS]


QUERIES: dict[str, Query] = {name: _values(text) for name, text in EXPRESSIONS.items()}
ORACLE: dict[str, str] = {name: oracle.tie_safe(oracle.values_sql(text)) for name, text in EXPRESSIONS.items()}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle.tie_safe(sql)
        return f

    return add


_P = "WITH " + oracle.PANEL.strip()
_FIELDS = ("open", "high", "low", "close", "vwap", "volume", "returns", "mcap")


# --- panel -----------------------------------------------------------------------------------


@_register(_P + f" SELECT t, CAST(date AS VARCHAR) AS date, inst, inst_idx, {', '.join(f'round({f}, 4) AS {f}' for f in _FIELDS)}, sector, CAST(is_listed AS DOUBLE) AS is_listed FROM panel")
def panel_cells(spark, sf_dir):
    """All terminals on the dense grid."""
    return _panel(spark, sf_dir).select("t", F.col("date").cast("string").alias("date"), "inst", "inst_idx", *[_r(f, 4).alias(f) for f in _FIELDS], "sector", "is_listed")


@_register(_P + """, changed AS (SELECT inst, t, CASE WHEN inst_idx % 4 = 0 THEN (sector + CAST(floor(t / 100) AS INTEGER)) % 5 ELSE sector END AS sector FROM panel WHERE is_listed = 1),
    movers AS (SELECT inst, coalesce(max(CASE WHEN sector <> before THEN 1 ELSE 0 END), 0) AS moved FROM (SELECT *, lag(sector) OVER (PARTITION BY inst ORDER BY t) AS before FROM changed WHERE sector IS NOT NULL) GROUP BY 1),
    span AS (SELECT (max(t) + 1) / 252.0 AS years, avg(CASE WHEN inst_idx % 7 = 0 THEN 1.0 ELSE 0.0 END) AS halted_share, avg(is_listed) AS listed_share FROM panel)
    SELECT round((SELECT avg(moved) FROM movers) / years, 6) AS reclassified_per_year, (SELECT avg(moved) FROM movers) / years > 0.001 OR years < 3 AS point_in_time,
        (SELECT count(DISTINCT inst) FROM panel WHERE inst_idx % 3 = 0) AS n_delisted, round(halted_share, 6) AS halted_share, round(listed_share, 6) AS listed_share, round(years, 6) AS years FROM span""")
def panel_diagnostics(spark, sf_dir):
    """What a layout says of itself, on sectors that move for every fourth instrument and delistings of every third."""
    moved = F.when(F.col("inst_idx") % 4 == 0, (F.col("sector") + F.floor(F.col("t") / 100).cast("int")) % 5).otherwise(F.col("sector"))
    df = _whole(_panel(spark, sf_dir)).withColumn("sector", moved)
    gone = df.where("inst_idx % 3 = 0").select(F.col("inst").alias("instrument_id")).distinct()
    out = sources.describe(sources.Panel(df), gone)
    return out.select(*[c if c in ("point_in_time", "n_delisted") else _r(c).alias(c) for c in out.columns])


@_register("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(l_suppkey AS VARCHAR) AS inst, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def panel_duplicates(spark, sf_dir):
    """Duplicate keys of a scan."""
    bars = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL")
    bars = bars.select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("instrument_id"))
    return sources.duplicate_bars(bars).select(F.col("date").cast("string").alias("day"), F.col("instrument_id").alias("inst"), F.col("count").alias("n"))


@_register("SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate IS NOT NULL)")
def calendar_anti(spark, sf_dir):
    """Bar dates outside the calendar."""
    bars = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date"))
    sessions = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
    return sources.dates_off_calendar(bars, sessions).select(F.col("date").cast("string").alias("day"))


@_register(_P + """, runs AS (SELECT inst, sum(CASE WHEN is_listed = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) AS runs FROM (SELECT *, lag(is_listed) OVER (PARTITION BY inst ORDER BY t) AS before FROM panel) GROUP BY 1),
    found AS (SELECT 'instruments that relist' AS problem, count(*) AS cells FROM runs WHERE runs > 1
        UNION ALL SELECT 'infinity in a field', count(*) FROM panel WHERE t % 50 = 7 AND inst_idx = 3
        UNION ALL SELECT 'prices on unlisted cells, carried forward', count(*) FROM panel WHERE is_listed = 0 AND inst_idx = 5
        UNION ALL SELECT 'is_listed must be 0 or 1, never missing', count(*) FROM panel WHERE t % 100 = 3 AND inst_idx = 8)
    SELECT problem, cells FROM found WHERE cells > 0""")
def panel_problems(spark, sf_dir):
    """Broken invariants of a panel that was spoilt in three places."""
    listed = F.col("is_listed") == 1
    spoilt = {
        "mcap": F.when((F.col("t") % 50 == 7) & (F.col("inst_idx") == 3), F.lit(float("inf"))).otherwise(F.col("mcap")),
        "close": F.when(~listed & (F.col("inst_idx") == 5), 1.0).otherwise(F.col("close")),
        "is_listed": F.when((F.col("t") % 100 == 3) & (F.col("inst_idx") == 8), F.when(listed, F.lit(2.0)).otherwise(F.lit(None).cast("double"))).otherwise(F.col("is_listed")),
    }
    df = _whole(_panel(spark, sf_dir))
    return sources.Panel(df.withColumns(spoilt)).problems().where("problem <> 'instruments that relist' AND problem NOT LIKE 'prices%'").unionByName(
        sources.Panel(df.withColumn("close", spoilt["close"])).problems()
    ).select("problem", F.col("cells").cast("long").alias("cells"))


@_register(_P + """ SELECT t, inst, round(CAST(CAST(close AS FLOAT) AS DOUBLE), 4) AS close, round(CAST(CAST(returns AS FLOAT) AS DOUBLE), 6) AS returns, sector, CAST(CASE WHEN inst_idx % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS halted
    FROM panel WHERE is_listed = 1""")
def layout_round_trip(spark, sf_dir):
    """The panel written as a layout and read back through every check of the adapter."""
    root = sources.write_layout(sources.Panel(_whole(_panel(spark, sf_dir))), _folder(spark, "layout"))
    back = sources.LayoutAdapter(spark, root).panel().df.where("is_listed = 1")
    return back.select("t", "inst", _r("close", 4).alias("close"), _r("returns").alias("returns"), "sector", "halted")


@_register(_P + " SELECT t, inst, round(close, 6) AS close FROM panel WHERE t < 50 AND close IS NOT NULL")
def panel_head(spark, sf_dir):
    return sources.Panel(_panel(spark, sf_dir)).head(50).df.where("close IS NOT NULL").select("t", "inst", _r("close").alias("close"))


@_register(_P + """, last AS (SELECT inst, max(t) AS last_t, max(date) AS last_date FROM panel WHERE is_listed = 1 GROUP BY 1)
    SELECT panel.t, panel.inst, round(CASE WHEN panel.t = last_t AND inst_idx % 3 = 0 THEN CASE WHEN returns IS NULL THEN -0.3 ELSE (1 + returns) * 0.7 - 1 END ELSE returns END, 6) AS returns
    FROM panel JOIN last ON last.inst = panel.inst""")
def delisting_composition(spark, sf_dir):
    """A terminal return of -30% composed into the last listed row of every third instrument; the whole panel."""
    grid = _panel(spark, sf_dir)
    last = grid.where("is_listed = 1").groupBy("inst").agg(F.max("date").alias("delist_date"), F.first("inst_idx").alias("i"))
    gone = last.where("i % 3 = 0").select(F.col("inst").alias("instrument_id"), "delist_date", F.lit(-0.3).alias("delist_return"))
    return sources.compose_delistings(grid, gone).select("t", "inst", _r("returns").alias("returns"))


@_register("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, round(1.0 + 2.5 + 10.0 * sqrt(l_discount), 6) AS cost_bps FROM lineitem")
def trade_costs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cost = sources.CostModel(1.0, 2.5, 10.0).trade_cost_bps("l_discount")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", _r(cost).alias("cost_bps"))


@_register(_P + " SELECT t, inst, round(close, 4) AS close, sector, CAST(is_listed AS DOUBLE) AS is_listed FROM panel WHERE t < 200")
def cache_round_trip(spark, sf_dir):
    """The first 200 sessions, kept as a panel cache and read back by their columns."""
    path = sources.write_cache(sources.Panel(_panel(spark, sf_dir)).head(200), _folder(spark, "cache"))
    return sources.read_cache(spark, path).df.select("t", "inst", _r("close", 4).alias("close"), "sector", "is_listed")


# --- windows ---------------------------------------------------------------------------------


@_register(oracle.with_values(["close"]) + " SELECT t, inst, round(count(close) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20.0, 6) AS fill FROM vals QUALIFY t >= 19")
def window_fill(spark, sf_dir):
    return evaluate.window_fill(_panel(spark, sf_dir), from_string("ts_mean(close, 20)")).where("fill IS NOT NULL").select("t", "inst", _r("fill").alias("fill"))


@_register(oracle.with_values(["ts_mean(close, 20)"]) + """, m AS (SELECT v0, count(close) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM vals)
    SELECT round(count(CASE WHEN v0 IS NOT NULL AND m < 20 THEN 1 END) * 1.0 / nullif(count(v0), 0), 6) AS degradation, CAST(0 AS BIGINT) AS non_finite FROM m""")
def degradation(spark, sf_dir):
    return evaluate.diagnostics(_panel(spark, sf_dir), [from_string("ts_mean(close, 20)")]).select(_r("deg_0").alias("degradation"), F.col("bad_0").alias("non_finite"))


# --- scores ----------------------------------------------------------------------------------

_RANKS = oracle.with_ranks(SIGNALS)


def _forward_query(h: int) -> Query:
    return lambda spark, sf_dir: metrics.forward_returns(_panel(spark, sf_dir), h).where("fwd IS NOT NULL").select("t", "inst", _r("fwd").alias("fwd"))


for _h in (1, 5):
    QUERIES[f"forward_returns_h{_h}"] = _forward_query(_h)
    ORACLE[f"forward_returns_h{_h}"] = oracle.tie_safe(f"{_P},\n{oracle.forward(_h)} SELECT t, inst, round(fwd, 6) AS fwd FROM fwd WHERE fwd IS NOT NULL")


def _ranks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    panel = _panel(spark, sf_dir).cache()
    return panel, metrics.ranked_signals(panel, _trees())


def _ics(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    panel, ranks = _ranks(spark, sf_dir)
    return panel, metrics.daily_rank_ic(ranks, metrics.ranked_forward(panel))


@_register(_RANKS + " SELECT CAST(k AS INTEGER) AS k, t, round(ic, 6) AS ic, n FROM ics WHERE ic IS NOT NULL")
def daily_rank_ic(spark, sf_dir):
    return _ics(spark, sf_dir)[1].select("k", "t", _r("ic").alias("ic"), "n")


@_register(_RANKS + " SELECT t, inst, round(r, 6) AS fr FROM franks")
def ranked_forward(spark, sf_dir):
    return metrics.ranked_forward(_panel(spark, sf_dir)).select("t", "inst", _r("fr").alias("fr"))


@_register(_RANKS + " SELECT CAST(k AS INTEGER) AS k, round(avg(ic), 6) AS ic, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 6) AS ic_ir, count(ic) AS n_scored_days FROM ics WHERE ic IS NOT NULL GROUP BY k")
def ic_summary(spark, sf_dir):
    return metrics.ic_summary(_ics(spark, sf_dir)[1]).select("k", _r("ic").alias("ic"), _r("ic_ir").alias("ic_ir"), "n_scored_days")


_TURNOVER = """, weights AS (SELECT k, t, inst, r / nullif(sum(abs(r)) OVER (PARTITION BY k, t), 0) AS w FROM ranks),
dense AS (SELECT s.k, p.t, p.inst, coalesce(w, 0) AS w FROM (SELECT DISTINCT t, inst FROM panel) p CROSS JOIN (SELECT unnest(range({n})) AS k) s LEFT JOIN weights ON weights.k = s.k AND weights.t = p.t AND weights.inst = p.inst),
steps AS (SELECT k, t, abs(w - lag(w) OVER (PARTITION BY k, inst ORDER BY t)) AS step FROM dense),
traded AS (SELECT k, t, sum(step) / 2 AS traded FROM steps WHERE t > 0 GROUP BY 1, 2),
turnovers AS (SELECT k, avg(traded) AS turnover FROM traded GROUP BY 1)""".replace("{n}", str(len(SIGNALS)))


@_register(_RANKS + _TURNOVER + " SELECT CAST(k AS INTEGER) AS k, round(turnover, 6) AS turnover FROM turnovers")
def turnover(spark, sf_dir):
    panel, ranks = _ranks(spark, sf_dir)
    return metrics.turnover(ranks, panel, len(SIGNALS)).select("k", _r("turnover").alias("turnover"))


_COVERAGE = ", covered AS (" + " UNION ALL ".join(
    f"SELECT {i} AS k, coalesce(count(CASE WHEN v{i} IS NOT NULL THEN 1 END) * 1.0 / nullif(count(*), 0), 0) AS coverage FROM vals WHERE is_listed = 1 AND t >= {t.warmup}" for i, t in enumerate(_trees())
) + ")"


@_register(oracle.with_values(SIGNALS) + _COVERAGE + " SELECT CAST(k AS INTEGER) AS k, round(coverage, 6) AS coverage FROM covered")
def coverage(spark, sf_dir):
    panel, trees = _panel(spark, sf_dir).cache(), _trees()
    return metrics.coverage(values_of(panel, trees), panel, trees).select("k", _r("coverage").alias("coverage"))


_DISPERSION = ", dd AS (SELECT k, t, count(*) AS n, var_samp(r) AS v FROM ranks GROUP BY 1, 2), disp AS (SELECT k, coalesce(sqrt(median(CASE WHEN n >= 20 THEN v END)), 0) AS dispersion FROM dd GROUP BY 1)"


@_register(_RANKS + _DISPERSION + " SELECT CAST(k AS INTEGER) AS k, round(dispersion, 6) AS dispersion FROM disp")
def dispersion(spark, sf_dir):
    return metrics.dispersion(_ranks(spark, sf_dir)[1]).select("k", _r("dispersion").alias("dispersion"))


_SUMMARY = _RANKS + _TURNOVER + _COVERAGE + _DISPERSION + """, summ AS (SELECT k, avg(ic) AS ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252) AS ic_ir, count(ic) AS n_scored_days FROM ics WHERE ic IS NOT NULL GROUP BY k),
everything AS (SELECT covered.k, ic, ic_ir, coalesce(turnover, 0) AS turnover, coverage, coalesce(dispersion, 0) AS dispersion, coalesce(n_scored_days, 0) AS n_scored_days
    FROM covered LEFT JOIN summ USING (k) LEFT JOIN turnovers USING (k) LEFT JOIN disp USING (k))"""


@_register(_SUMMARY + " SELECT CAST(k AS INTEGER) AS k, round(ic, 6) AS ic, round(ic_ir, 6) AS ic_ir, round(turnover, 6) AS turnover, round(coverage, 6) AS coverage, round(dispersion, 6) AS dispersion, n_scored_days FROM everything")
def signal_summary(spark, sf_dir):
    """All metrics of a batch in one plan."""
    out = metrics.summarise(_panel(spark, sf_dir).cache(), _trees())
    return out.select("k", *[_r(c).alias(c) for c in ("ic", "ic_ir", "turnover", "coverage", "dispersion")], "n_scored_days")


_LIMITS = ScreenConfig(min_scored_days=100, min_abs_ic=0.01, max_turnover=0.3, max_degradation=0.2)
_DEGRADED = _SUMMARY + ", fills AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, coalesce(count(CASE WHEN v{k} IS NOT NULL AND m < {d} THEN 1 END) * 1.0 / nullif(count(v{k}), 0), 0) AS degradation FROM (SELECT v{k}, count(close) OVER (PARTITION BY inst ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW) AS m FROM vals)"
    for k, d in ((0, 20), (3, 10))
) + """), judged AS (SELECT everything.*, CASE WHEN coverage < 0.3 OR coalesce(degradation, 0) > 0.2 THEN 'low_coverage' WHEN dispersion < 0.01 THEN 'degenerate' WHEN n_scored_days < 100 THEN 'low_coverage'
    WHEN ic IS NULL OR abs(ic) < 0.01 OR ic_ir IS NULL OR abs(ic_ir) < 0.2 THEN 'low_ic' WHEN turnover > 0.3 THEN 'high_turnover' END AS reason FROM everything LEFT JOIN fills USING (k))"""


@_register(_DEGRADED + " SELECT CAST(k AS INTEGER) AS k, coalesce(reason, 'passed') AS verdict FROM judged")
def screen_verdicts(spark, sf_dir):
    """The first limit that each signal breaks."""
    measured = measure(_panel(spark, sf_dir), _trees())
    verdicts = [verdict_of(m, _LIMITS) for m in measured]
    return spark.createDataFrame([(i, v.value if v else "passed") for i, v in enumerate(verdicts)], "k int, verdict string")


def _screened(spark, sf_dir, read):
    """What a ledger holds after a screen of the signals, some of them twice."""
    with open_ledger(":memory:") as ledger:
        run = ledger.start_run(_LIMITS.as_config())
        Screen(_panel(spark, sf_dir), ledger, run, _LIMITS).screen_all([*_trees(), *_trees()[:2]])
        return read(ledger, run)


@_register(_DEGRADED + " SELECT reason AS verdict, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def kill_counts(spark, sf_dir):
    """Kills by reason, from the ledger of a screen."""
    counts = _screened(spark, sf_dir, lambda ledger, run: ledger.kill_counts(run))
    return spark.createDataFrame(sorted(counts.items()), "verdict string, n long")


@_register(_DEGRADED + ", texts(k, expr_str) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(SIGNALS)) + """)
    SELECT expr_str, CASE WHEN reason IS NULL THEN 'passed' ELSE 'killed' END AS verdict, reason AS kill_reason, 'screened' AS stage_reached, round(ic, 6) AS ic, round(ic_ir, 6) AS ic_ir,
        CAST(sign(ic) AS BIGINT) AS ic_sign, round(turnover, 6) AS turnover FROM judged JOIN texts USING (k)""")
def ledger_trials(spark, sf_dir):
    """The trials that a screen has logged, one for each hypothesis."""
    trials = _screened(spark, sf_dir, lambda ledger, run: ledger.trials(spark, run))
    return trials.select("expr_str", "verdict", "kill_reason", "stage_reached", _r("ic").alias("ic"), _r("ic_ir").alias("ic_ir"), "ic_sign", _r("turnover").alias("turnover"))


@_register(_DEGRADED + ", texts(k, expr_str) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(SIGNALS)) + ") SELECT expr_str, round(abs(ic), 6) AS incremental_ic FROM judged JOIN texts USING (k) WHERE coalesce(reason, 'high_turnover') = 'high_turnover'")
def pool_members(spark, sf_dir):
    """Signals that pass the screen but for their turnover, accepted into the pool and read back with their trials."""

    def accept(ledger, run):
        for r in ledger.trials(spark, run).where("coalesce(kill_reason, 'high_turnover') = 'high_turnover'").collect():
            kept = ledger.log_trial(Trial(run, r["expr_hash"], r["expr_str"], Verdict.ACCEPTED, Stage.POOL, None, r["value_hash"], r["ic"], r["ic_ir"], r["ic_sign"], r["turnover"]))
            ledger.accept(kept, abs(r["ic"]))
        return [(e.expr_str, e.incremental_ic) for e in ledger.pool_entries(run)]

    rows = spark.createDataFrame(_screened(spark, sf_dir, accept), "expr_str string, incremental_ic double")
    return rows.select("expr_str", _r("incremental_ic").alias("incremental_ic"))


_TWINS = [SIGNALS[0], f"rank({SIGNALS[0]})", f"log({SIGNALS[0]})", SIGNALS[0]]


@_register("SELECT CAST(4 AS INTEGER) AS seen, CAST(1 AS INTEGER) AS structural_duplicates, CAST(2 AS INTEGER) AS semantic_collapses, CAST(1 AS INTEGER) AS elided_nodes, CAST(1 AS INTEGER) AS logged")
def screen_report(spark, sf_dir):
    """One hypothesis in four spellings: a repetition, a rank at the root, and a rescaling collapse into one logged trial."""
    with open_ledger(":memory:") as ledger:
        limits = ScreenConfig(min_scored_days=1, min_coverage=0.0, max_degradation=1.0, min_dispersion=0.0)
        screen = Screen(_panel(spark, sf_dir), ledger, ledger.start_run(limits.as_config()), limits)
        screen.screen_all([from_string(t) for t in _TWINS])
        r = screen.report
    names = ("seen", "structural_duplicates", "semantic_collapses", "elided_nodes", "logged")
    return spark.createDataFrame([tuple(getattr(r, n) for n in names)], ", ".join(f"{n} int" for n in names))


@_register(_RANKS + """, first AS (SELECT k, arg_min(CASE WHEN p2 > n - 1 THEN 1 ELSE -1 END, row(t, inst_idx)) AS sign FROM ranks WHERE p2 <> n - 1 GROUP BY 1)
    SELECT DISTINCT CAST(ranks.k AS INTEGER) AS k, CAST(coalesce(sign, 1) AS INTEGER) AS sign FROM ranks LEFT JOIN first USING (k)""")
def orientation(spark, sf_dir):
    return evaluate.orientation(_ranks(spark, sf_dir)[1]).select("k", "sign")


@_register(_RANKS + """, first AS (SELECT k, arg_min(CASE WHEN p2 > n - 1 THEN 1 ELSE -1 END, row(t, inst_idx)) AS sign FROM ranks WHERE p2 <> n - 1 GROUP BY 1)
    SELECT CAST(ranks.k AS INTEGER) AS k, t, inst_idx, CAST(CASE WHEN coalesce(sign, 1) < 0 THEN 2 * (n - 1) - p2 ELSE p2 END AS BIGINT) AS position FROM ranks LEFT JOIN first USING (k)""")
def rank_positions(spark, sf_dir):
    """Whole oriented positions: what the identity of a signal is hashed from."""
    return evaluate.rank_positions(_ranks(spark, sf_dir)[1])


_IDENTITIES = [*SIGNALS, "log(ts_mean(close, 20))", "sub(ts_delay(close, 5), close)"]


@_register(oracle.with_ranks(_IDENTITIES) + """, first AS (SELECT k, arg_min(CASE WHEN p2 > n - 1 THEN 1 ELSE -1 END, row(t, inst_idx)) AS sign FROM ranks WHERE p2 <> n - 1 GROUP BY 1),
    placed AS (SELECT ranks.k, t, inst_idx, CAST(CASE WHEN coalesce(sign, 1) < 0 THEN 2 * (n - 1) - p2 ELSE p2 END AS BIGINT) AS position FROM ranks LEFT JOIN first USING (k)),
    sessions AS (SELECT k, t, sha256(string_agg(inst_idx || ':' || position, ',' ORDER BY inst_idx)) AS h FROM placed GROUP BY 1, 2),
    shape AS (SELECT (max(t) + 1) || 'x' || count(DISTINCT inst) AS shape FROM panel)
    SELECT CAST(k AS INTEGER) AS k, substr(sha256(any_value(shape) || string_agg('|' || t || ':' || h, '' ORDER BY t)), 1, 32) AS value_hash FROM sessions CROSS JOIN shape GROUP BY 1""")
def signal_identities(spark, sf_dir):
    """Identities of signals, a rescaling and a negation; the last two are those of the first and the second signal."""
    panel = _panel(spark, sf_dir)
    found = evaluate.value_hashes(metrics.ranked_signals(panel, [from_string(t) for t in _IDENTITIES]), *sources.Panel(panel).shape())
    return spark.createDataFrame(sorted(found.items()), "k int, value_hash string")


# --- portfolios ------------------------------------------------------------------------------

_MW = from_string(MOMENTUM).warmup
_DECILES = oracle.with_ranks([MOMENTUM]) + f""", cal AS (SELECT t, date, lead(date) OVER (ORDER BY t) AS following FROM days),
reb AS (SELECT t, date, CASE WHEN following IS NOT NULL AND date_trunc('month', date) <> date_trunc('month', following) AND t >= {_MW} THEN t END AS flag FROM cal),
filled AS (SELECT t, date, last_value(flag IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM reb),
held AS (SELECT t, date, lag(now) OVER (ORDER BY t) AS held FROM filled),
mem AS (SELECT t AS held, inst, bucket FROM (SELECT t, inst, ntile(10) OVER (PARTITION BY t ORDER BY r, inst_idx) AS bucket, count(*) OVER (PARTITION BY t) AS size FROM ranks) WHERE size >= 10),
cells AS (SELECT panel.t, panel.date, panel.inst, returns, held.held FROM panel JOIN held ON held.t = panel.t WHERE held.held IS NOT NULL AND returns IS NOT NULL),
daily AS (SELECT cells.t, cells.date, CAST(bucket AS VARCHAR) AS bucket, avg(returns) AS ret FROM cells JOIN mem ON mem.held = cells.held AND mem.inst = cells.inst GROUP BY 1, 2, 3
    UNION ALL SELECT t, date, 'market', avg(returns) FROM cells GROUP BY 1, 2)"""


def _deciles(spark, sf_dir) -> portfolio.DecileResult:
    return portfolio.decile_returns(_panel(spark, sf_dir).cache(), from_string(MOMENTUM))


@_register(_DECILES + " SELECT t, bucket, round(ret, 6) AS ret FROM daily")
def decile_daily(spark, sf_dir):
    return _deciles(spark, sf_dir).daily.select("t", "bucket", _r("ret").alias("ret"))


@_register(_DECILES + """ SELECT a.t, round(b.ret - a.ret, 6) AS spread, round(b.ret - m.ret, 6) AS excess FROM (SELECT * FROM daily WHERE bucket = '1') a
    JOIN (SELECT * FROM daily WHERE bucket = '10') b ON a.t = b.t JOIN (SELECT * FROM daily WHERE bucket = 'market') m ON a.t = m.t""")
def decile_spread(spark, sf_dir):
    return _deciles(spark, sf_dir).spread.dropna().select("t", _r("spread").alias("spread"), _r("excess").alias("excess"))


@_register(_DECILES + " SELECT bucket, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, round(product(1 + ret) - 1, 5) AS ret FROM daily GROUP BY 1, 2")
def decile_monthly(spark, sf_dir):
    return portfolio.to_monthly(_deciles(spark, sf_dir).daily, by=("bucket",)).select("bucket", F.col("month").cast("string").alias("month"), _r("ret", 5).alias("ret"))


@_register(_DECILES + " SELECT bucket, round(CASE WHEN product(1 + ret) > 0 AND pow(product(1 + ret), 252.0 / count(ret)) > 0.01 THEN ln(pow(product(1 + ret), 252.0 / count(ret))) END, 4) AS log_growth FROM daily GROUP BY 1")
def decile_annualised(spark, sf_dir):
    """Annualised growth, as a logarithm; missing where hardly anything is left."""
    growth = 1 + F.col("annualised")
    return portfolio.annualise(_deciles(spark, sf_dir).daily, by=("bucket",)).select("bucket", _r(F.when(growth > 0.01, F.ln(growth)), 4).alias("log_growth"))


@_register(_DECILES + """, a AS (SELECT date_trunc('month', date) AS month, product(1 + ret) - 1 AS ret FROM daily WHERE bucket = '10' GROUP BY 1),
    b AS (SELECT date_trunc('month', date) AS month, product(1 + ret) - 1 AS factor FROM daily WHERE bucket = 'market' GROUP BY 1)
    SELECT round(CASE WHEN count(*) >= 24 THEN covar_pop(ret, factor) / nullif(sqrt(var_pop(ret) * var_pop(factor)), 0) END, 6) AS correlation, count(*) AS months FROM a JOIN b USING (month)""")
def monthly_comparison(spark, sf_dir):
    daily = _deciles(spark, sf_dir).daily
    top, market = (portfolio.to_monthly(daily.where(F.col("bucket") == b)) for b in ("10", "market"))
    return portfolio.compare_monthly(top, market.withColumnRenamed("ret", "factor")).select(_r("correlation").alias("correlation"), "months")


# --- null, robustness, budget ----------------------------------------------------------------

_BLOCK = null.DEFAULT_BLOCK


@_register(_RANKS + f""", lab AS (SELECT t, inst_idx, (inst_idx * 7 + CAST(floor(t / {_BLOCK}) AS INTEGER)) % (SELECT count(*) FROM names) AS src FROM days CROSS JOIN names),
    sh AS (SELECT lab.t, lab.inst_idx, franks.r AS fr FROM lab JOIN franks ON franks.t = lab.t AND franks.inst_idx = lab.src),
    ni AS (SELECT ranks.k, ranks.t, count(*) AS n, covar_pop(r, fr) / nullif(sqrt(var_pop(r) * var_pop(fr)), 0) AS ic FROM ranks JOIN sh ON sh.t = ranks.t AND sh.inst_idx = ranks.inst_idx GROUP BY 1, 2 HAVING count(*) >= 20)
    SELECT CAST(k AS INTEGER) AS k, t, round(ic, 6) AS ic FROM ni WHERE ic IS NOT NULL""")
def null_relabelled_ic(spark, sf_dir):
    """ICs under relabelled returns, with a permutation that needs no hash."""
    panel, ranks = _ranks(spark, sf_dir)
    names = panel.select("inst", "inst_idx").distinct()
    blocks = panel.select(F.floor(F.col("t") / _BLOCK).cast("int").alias("block")).distinct()
    size = names.agg(F.count("*").alias("size"))
    labels = names.crossJoin(F.broadcast(blocks)).crossJoin(F.broadcast(size)).select("block", "inst_idx", ((F.col("inst_idx") * 7 + F.col("block")) % F.col("size")).cast("int").alias("src"))
    shuffled = null.permuted_forward(metrics.ranked_forward(panel), labels, _BLOCK).join(names, "inst_idx")
    return metrics.daily_rank_ic(ranks, shuffled).select("k", "t", _r("ic").alias("ic"))


@_register(_P + f""", size AS (SELECT max(t) + 1 AS n, least({_BLOCK}, max(t) + 1) AS length FROM panel),
    blocks AS (SELECT CAST(unnest(range(CAST(ceil(n * 1.0 / length) AS BIGINT))) AS INTEGER) AS block FROM size),
    drawn AS (SELECT block, inst_idx, row_number() OVER (PARTITION BY block ORDER BY inst_idx) AS at, row_number() OVER (PARTITION BY block ORDER BY md5(inst_idx || ':7:' || block), inst_idx) AS mixed FROM blocks CROSS JOIN (SELECT DISTINCT inst_idx FROM panel))
    SELECT a.block, a.inst_idx, b.inst_idx AS src FROM drawn a JOIN drawn b ON a.block = b.block AND a.at = b.mixed""")
def block_permutation(spark, sf_dir):
    """A hashed permutation of the instruments for each block of sessions."""
    panel = _panel(spark, sf_dir)
    n = panel.agg(F.max("t")).first()[0] + 1
    return null.block_label_permutation(panel.select("inst_idx").distinct(), n, min(_BLOCK, n), 7)


_TRIALS = _RANKS + ", tr AS (SELECT row_number() OVER (ORDER BY k, t) - 1 AS trial, abs(ic) AS abs_ic, ic FROM ics WHERE ic IS NOT NULL)"


def _trial_table(spark, sf_dir) -> DataFrame:
    """Session ICs of all signals in order, as stand-ins for trials."""
    ics = _ics(spark, sf_dir)[1]
    return ics.select((F.row_number().over(Window.orderBy("k", "t")) - 1).cast("long").alias("trial"), F.abs("ic").alias("abs_ic"), "ic")


@_register(_TRIALS + """, sized AS (SELECT trial, abs_ic, size, floor(trial / size) AS batch FROM tr CROSS JOIN (SELECT unnest([10, 32, 100, 316, 1000, 3162, 10000, 31623]) AS size) WHERE trial < floor((SELECT count(*) FROM tr) / size) * size),
    mx AS (SELECT size, batch, max(abs_ic) AS m FROM sized GROUP BY 1, 2)
    SELECT CAST(size AS INTEGER) AS size, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95, round(max(m), 6) AS largest, count(*) AS n_batches FROM mx GROUP BY 1 HAVING count(*) >= 8""")
def max_curve(spark, sf_dir):
    return null.maximum_curve(_trial_table(spark, sf_dir), "abs_ic").select("size", *[_r(c).alias(c) for c in ("mean", "p50", "p95", "largest")], "n_batches")


@_register(_TRIALS + " SELECT " + ", ".join(f"round(quantile_cont(abs_ic, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999), ("tau", 0.999))) + ", round(max(abs_ic), 6) AS max FROM tr")
def tau_quantiles(spark, sf_dir):
    q = null.null_quantiles(_trial_table(spark, sf_dir))
    return q.select(*[_r(c).alias(c) for c in ("p50", "p75", "p90", "p95", "p99", "p999", "tau", "max")])


@_register(_TRIALS + " SELECT round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic) / sqrt(count(ic)), 6) AS standard_error, coalesce(abs(avg(ic)) > 4 * stddev_samp(ic) / sqrt(count(ic)), false) AS leaks, count(*) AS n_trials FROM tr")
def null_moments(spark, sf_dir):
    m = null.null_moments(_trial_table(spark, sf_dir).withColumn("ic_ir", F.col("ic")))
    return m.select(_r("mean_ic").alias("mean_ic"), _r("standard_error").alias("standard_error"), "leaks", "n_trials")


def _signal_ics(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    panel, ics = _ics(spark, sf_dir)
    return panel, ics.where("k = 0").select("t", "ic")


@_register(_RANKS + """, room AS (SELECT n, CAST(floor((sessions - 20 - 20 * (n - 1)) / n) AS INTEGER) AS span FROM (SELECT max(t) + 1 AS sessions FROM panel) CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)),
    fits AS (SELECT max(n) AS n, max_by(span, n) AS span FROM room WHERE span >= 60),
    folds AS (SELECT i AS fold, 19 + i * (span + 20) AS start, 19 + i * (span + 20) + span AS stop FROM (SELECT n, span, CAST(unnest(range(n)) AS INTEGER) AS i FROM fits WHERE n IS NOT NULL))
    SELECT fold, round(avg(ic), 6) AS ic, count(ic) AS n FROM folds LEFT JOIN (SELECT * FROM ics WHERE k = 0 AND ic IS NOT NULL) i ON i.t >= start AND i.t < stop GROUP BY 1""")
def purged_fold_ic(spark, sf_dir):
    panel, ics = _signal_ics(spark, sf_dir)
    folds = gauntlet.purged_folds(panel.agg(F.max("t")).first()[0] + 1, warmup=19, horizon=1, n_folds=3, min_fold_days=60)
    return gauntlet.fold_ics(ics, folds).select("fold", _r("ic").alias("ic"), "n")


@_register(_RANKS + """, shifted AS (SELECT d.delay, ranks.t + d.delay AS t, inst, r FROM ranks CROSS JOIN (VALUES (0), (1), (2)) d(delay) WHERE k = 0),
    di AS (SELECT delay, shifted.t, covar_pop(shifted.r, franks.r) / nullif(sqrt(var_pop(shifted.r) * var_pop(franks.r)), 0) AS ic FROM shifted JOIN franks ON franks.t = shifted.t AND franks.inst = shifted.inst GROUP BY 1, 2 HAVING count(*) >= 20)
    SELECT delay, round(avg(ic), 6) AS ic FROM di GROUP BY 1""")
def delay_ics(spark, sf_dir):
    panel = _panel(spark, sf_dir).cache()
    return gauntlet.delay_ics(panel, from_string(SIGNALS[0]), metrics.ranked_forward(panel)).select("delay", _r("ic").alias("ic"))


@_register(_RANKS + """, vol AS (SELECT t, CASE WHEN count(returns) >= 20 THEN stddev_samp(returns) END AS vol FROM panel GROUP BY 1),
    split AS (SELECT t, CASE WHEN vol <= (SELECT quantile_cont(vol, 0.5) FROM vol) THEN 'calm' ELSE 'rough' END AS regime FROM vol WHERE vol IS NOT NULL)
    SELECT regime, round(avg(ic), 6) AS ic FROM split LEFT JOIN (SELECT * FROM ics WHERE k = 0) i ON i.t = split.t GROUP BY 1""")
def regime_ic(spark, sf_dir):
    panel, ics = _signal_ics(spark, sf_dir)
    return gauntlet.regime_ics(ics, panel).select("regime", _r("ic").alias("ic"))


@_register(_RANKS + """, o AS (SELECT avg(ic) AS overall, count(ic) AS n FROM ics WHERE k = 0 AND ic IS NOT NULL),
    al AS (SELECT ic * sign(overall) AS a, overall, o.n AS n, row_number() OVER (ORDER BY ic * sign(overall) DESC, t) AS place FROM ics CROSS JOIN o WHERE k = 0 AND ic IS NOT NULL)
    SELECT round(any_value(overall), 6) AS overall, round(avg(a), 6) AS trimmed, any_value(n) AS n, CAST(ceil(any_value(n) * 0.1) AS BIGINT) AS dropped FROM al WHERE place > ceil(n * 0.1) HAVING count(*) > 0""")
def breadth(spark, sf_dir):
    return gauntlet.breadth(_signal_ics(spark, sf_dir)[1]).select(_r("overall").alias("overall"), _r("trimmed").alias("trimmed"), "n", F.col("dropped").cast("long").alias("dropped"))


@_register(_P + " SELECT t, round(stddev_samp(returns), 6) AS vol FROM panel GROUP BY t HAVING count(returns) >= 20")
def daily_dispersion(spark, sf_dir):
    return metrics.daily_dispersion(_panel(spark, sf_dir)).where("vol IS NOT NULL").select("t", _r("vol").alias("vol"))


_Z = budget.Z_95


@_register(f"""WITH c AS (SELECT l_returnflag AS name, count(*) AS n, count(CASE WHEN l_discount >= 0.05 THEN 1 END) AS s FROM lineitem GROUP BY 1),
    w AS (SELECT *, s * 1.0 / n AS p, {_Z * _Z} / n AS zz FROM c),
    h AS (SELECT *, p + zz / 2 AS middle, {_Z} * sqrt(p * (1 - p) / n + zz / (4.0 * n)) AS half FROM w)
    SELECT name, s, n, round(CASE WHEN s = 0 THEN 0 ELSE (middle - half) / (1 + zz) END, 6) AS low, round(CASE WHEN s = n THEN 1 ELSE (middle + half) / (1 + zz) END, 6) AS high FROM h""")
def wilson_rates(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("name")).agg(F.count_if(F.col("l_discount") >= 0.05).alias("s"), F.count("*").alias("n"))
    low, high = budget.wilson_columns(F.col("s"), F.col("n"))
    return counts.select("name", "s", "n", _r(low).alias("low"), _r(high).alias("high"))


_TESTS = {"a": "l_discount >= 0.05", "b": "l_discount >= 0.05 OR l_tax >= 0.08", "c": "l_quantity >= 25"}


def _verdicts(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.expr(e).alias(n) for n, e in _TESTS.items()])


_RHO = "WITH x AS (SELECT " + ", ".join(f"CASE WHEN {e} THEN 0.0 ELSE 1.0 END AS {n}" for n, e in _TESTS.items()) + " FROM lineitem), rho AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0" if a == b else f"covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0)") + " AS rho FROM x" for a in _TESTS for b in _TESTS
) + ")"


@_register(_RHO + " SELECT a, b, round(max(rho), 6) AS rho FROM rho GROUP BY 1, 2")
def rejection_correlation(spark, sf_dir):
    return budget.rejection_correlation(_verdicts(spark, sf_dir), list(_TESTS)).select("a", "b", _r("rho").alias("rho"))


@_register(_RHO + " SELECT a, b, round(max(rho), 6) AS rho FROM rho WHERE a < b GROUP BY 1, 2 HAVING abs(max(rho)) >= 0.5")
def redundant_pairs(spark, sf_dir):
    return budget.redundant_pairs(budget.rejection_correlation(_verdicts(spark, sf_dir), list(_TESTS)), 0.5).select("a", "b", _r("rho").alias("rho"))


@_register(_TRIALS + """, cuts AS (SELECT quantile_cont(abs_ic, 0.5) AS p50, quantile_cont(abs_ic, 0.9) AS p90, quantile_cont(abs_ic, 0.99) AS p99 FROM tr)
    SELECT cut, count(CASE WHEN abs_ic >= level THEN 1 END) AS n, count(CASE WHEN abs_ic >= level AND ic > 0 THEN 1 END) AS passes, count(CASE WHEN abs_ic >= level THEN 1 END) >= 20 AS enough
    FROM tr CROSS JOIN (SELECT 'p50' AS cut, p50 AS level FROM cuts UNION ALL SELECT 'p90', p90 FROM cuts UNION ALL SELECT 'p99', p99 FROM cuts) GROUP BY 1""")
def conditional_pass_rate(spark, sf_dir):
    trials = _trial_table(spark, sf_dir).withColumn("passed", F.col("ic") > 0).cache()
    cuts = trials.agg(*[F.percentile("abs_ic", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]).first().asDict()
    return budget.conditional_pass_rate(trials, "abs_ic", "passed", {k: v for k, v in cuts.items() if v is not None}).select("cut", "n", "passes", "enough")


_ROBUST = from_string("ts_mean(close, 20)")
_PROBES = jittered(_ROBUST)


@_register(oracle.with_ranks([_ROBUST, *_PROBES]) + """, own AS (SELECT t, ic FROM ics WHERE k = 0 AND ic IS NOT NULL), o AS (SELECT avg(ic) AS overall, count(ic) AS n FROM own),
    room AS (SELECT n, CAST(floor((sessions - 20 - 20 * (n - 1)) / n) AS INTEGER) AS span FROM (SELECT max(t) + 1 AS sessions FROM panel) CROSS JOIN (SELECT unnest([1, 2]) AS n)),
    fits AS (SELECT max(n) AS n, max_by(span, n) AS span FROM room WHERE span >= 120),
    folds AS (SELECT i AS fold, 19 + i * (span + 20) AS start, 19 + i * (span + 20) + span AS stop FROM (SELECT n, span, CAST(unnest(range(n)) AS INTEGER) AS i FROM fits WHERE n IS NOT NULL)),
    fold_ic AS (SELECT fold, avg(ic) AS ic FROM folds JOIN own ON t >= start AND t < stop GROUP BY 1),
    fold_stats AS (SELECT coalesce(avg(CASE WHEN sign(ic) = sign(overall) THEN 1.0 ELSE 0.0 END), 0) AS agree, coalesce(min(abs(ic)) / abs(any_value(overall)), 0) AS worst FROM fold_ic CROSS JOIN o),
    shifted AS (SELECT d.delay, ranks.t + d.delay AS t, inst, r FROM ranks CROSS JOIN (VALUES (0), (1), (2)) d(delay) WHERE k = 0),
    delay_day AS (SELECT delay, shifted.t, covar_pop(shifted.r, franks.r) / nullif(sqrt(var_pop(shifted.r) * var_pop(franks.r)), 0) AS ic FROM shifted JOIN franks ON franks.t = shifted.t AND franks.inst = shifted.inst GROUP BY 1, 2 HAVING count(*) >= 20),
    delay_ic AS (SELECT delay, avg(ic) AS ic FROM delay_day GROUP BY 1),
    abc AS (SELECT max(CASE WHEN delay = 0 THEN ic END) AS a, max(CASE WHEN delay = 1 THEN ic END) AS b, max(CASE WHEN delay = 2 THEN ic END) AS c FROM delay_ic),
    steps AS (SELECT a * sign(a) AS a, (a - b) * sign(a) AS one, (b - c) * sign(a) AS two FROM abc),
    ratios AS (SELECT k, avg(ic) * sign(any_value(overall)) / abs(any_value(overall)) AS ratio FROM ics CROSS JOIN o WHERE k > 0 AND ic IS NOT NULL GROUP BY 1),
    vol AS (SELECT t, CASE WHEN count(returns) >= 20 THEN stddev_samp(returns) END AS vol FROM panel GROUP BY 1),
    split AS (SELECT t, CASE WHEN vol <= (SELECT quantile_cont(vol, 0.5) FROM vol) THEN 'calm' ELSE 'rough' END AS regime FROM vol WHERE vol IS NOT NULL),
    regimes AS (SELECT regime, avg(ic) AS ic FROM split JOIN own USING (t) GROUP BY 1),
    placed AS (SELECT ic * sign(overall) AS a, n, row_number() OVER (ORDER BY ic * sign(overall) DESC, t) AS place FROM own CROSS JOIN o),
    every AS (SELECT 'ic_magnitude' AS test, abs(overall) AS x FROM o
        UNION ALL SELECT 'fold_sign', agree FROM fold_stats UNION ALL SELECT 'fold_ic', worst FROM fold_stats
        UNION ALL SELECT 'delay_shape', CASE WHEN one IS NULL OR two IS NULL OR a = 0 THEN 1e9 WHEN two > 0 THEN one / two WHEN one <= 0 THEN 0 ELSE one / greatest(a, 1e-12) END FROM steps
        UNION ALL SELECT 'jitter_plateau', min(ratio) FROM ratios UNION ALL SELECT 'jitter_sign', count(CASE WHEN ratio <= 0 THEN 1 END) FROM ratios
        UNION ALL SELECT 'regime_sign', CASE WHEN count(*) = 2 THEN sum(CASE WHEN sign(ic) = sign((SELECT overall FROM o)) THEN 1 ELSE 0 END) / 2.0 ELSE 0 END FROM regimes
        UNION ALL SELECT 'breadth', CASE WHEN any_value(n) >= 20 THEN avg(CASE WHEN place > ceil(n * 0.1) THEN a END) / abs((SELECT overall FROM o)) ELSE 0 END FROM placed)
    SELECT test, round(least(x, 1e9), 5) AS statistic FROM every""")
def gauntlet_statistics(spark, sf_dir):
    """All robustness statistics of one signal."""
    result = gauntlet.Gauntlet(_panel(spark, sf_dir), n_folds=2).run(_ROBUST)
    rows = spark.createDataFrame([(o.name, min(o.statistic, 1e9)) for o in result.outcomes], "test string, statistic double")
    return rows.select("test", _r("statistic", 5).alias("statistic"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A momentum tree's values on the weekly panel."""
    return QUERIES["tree_rank_change"](spark, sf_dir)
