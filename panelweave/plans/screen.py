"""The screen: batches of candidates measured in one plan, judged in a fixed order, logged once."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, strip_elidable_root
from ..operators.metrics import ranked_forward, ranked_signals, summarise
from .evaluate import _windowed, diagnostics, value_hashes
from .ledger import KillReason, Ledger, Stage, Trial, Verdict


@dataclass(frozen=True)
class ScreenConfig:
    """Limits a candidate must meet."""

    min_coverage: float = 0.30
    max_degradation: float = 0.50
    min_dispersion: float = 0.01
    min_scored_days: int = 250
    min_abs_ic: float = 0.005
    min_ic_ir: float = 0.20
    max_turnover: float = 0.40
    horizon: int = 1

    @staticmethod
    def from_calibration(calibration, **limits) -> ScreenConfig:
        """Take the admission threshold and horizon that a null calibration measured."""
        return ScreenConfig(min_abs_ic=calibration.tau, horizon=calibration.horizon, **limits)

    def as_config(self) -> dict[str, float | int]:
        return {f"screen_{k}": v for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Outcome:
    tree: Expr
    expr_hash: str
    verdict: Verdict
    stage: Stage
    reason: KillReason | None = None
    value_hash: str | None = None
    metrics: dict | None = None
    logged: bool = True
    elided: int = 0


@dataclass
class ScreenReport:
    seen: int = 0
    structural_duplicates: int = 0
    semantic_collapses: int = 0
    elided_nodes: int = 0
    logged: int = 0
    passed: int = 0
    kills: Counter = field(default_factory=Counter)


def _finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def unfit(m: dict, c: ScreenConfig) -> KillReason | None:
    """Why a candidate isn't worth an identity: too few cells, or nearly no spread."""
    if m["coverage"] < c.min_coverage or m["degradation"] > c.max_degradation:
        return KillReason.LOW_COVERAGE
    return KillReason.DEGENERATE if m["dispersion"] < c.min_dispersion else None


def verdict_of(m: dict, c: ScreenConfig) -> KillReason | None:
    """The first limit that a candidate's metrics break, in the order of their cost."""
    return unfit(m, c) or scored_verdict(m, c)


def scored_verdict(m: dict, c: ScreenConfig) -> KillReason | None:
    if m["n_scored_days"] < c.min_scored_days:
        return KillReason.LOW_COVERAGE
    if _finite(m["ic"]) is None or abs(m["ic"]) < c.min_abs_ic or _finite(m["ic_ir"]) is None or abs(m["ic_ir"]) < c.min_ic_ir:
        return KillReason.LOW_IC
    if _finite(m["turnover"]) is None or m["turnover"] > c.max_turnover:
        return KillReason.HIGH_TURNOVER
    return None


def measure(panel: DataFrame, trees: list[Expr], horizon: int = 1, forward: DataFrame | None = None, strict: bool = False) -> list[dict]:
    """Metrics and degradation of each tree: two small results for the whole batch."""
    rows = {r["k"]: r.asDict() for r in summarise(panel, trees, horizon, forward, strict).collect()}
    row, nodes = diagnostics(panel, trees, strict).first().asDict(), _windowed(trees)
    share = {n.digest: row[f"deg_{j}"] for j, n in enumerate(nodes)}
    for i, t in enumerate(trees):
        rows[i]["degradation"] = max((share[n.digest] for n in t.walk() if n.digest in share), default=0.0)
    return [rows[i] for i in range(len(trees))]


class Screen:
    """Runs candidates through the limits and writes one ledger row per hypothesis.

    Candidates seen before, in this or an earlier session of the run, are known from the ledger.
    """

    def __init__(self, panel: DataFrame, ledger: Ledger, run_id: str, config: ScreenConfig | None = None, calibration=None, snapshot: str | None = None, strict: bool = False):
        self.config = config or ScreenConfig()
        if calibration is not None:
            calibration.assert_applies_to(snapshot, self.config.horizon)
            if self.config.min_abs_ic != calibration.tau:
                raise ValueError("min_abs_ic isn't the calibrated threshold; use ScreenConfig.from_calibration")
        self.panel, self.ledger, self.run_id, self.strict = panel, ledger, run_id, strict
        self.report = ScreenReport()
        self.forward = ranked_forward(panel, self.config.horizon, strict).cache()
        size = panel.agg((F.max("t") + 1).alias("n"), F.countDistinct("inst").alias("m")).first()
        self.shape = size["n"] or 0, size["m"]
        self.exprs, self.values = ledger.seen(run_id)

    def screen(self, tree: Expr) -> Outcome:
        return self.screen_all([tree])[0]

    def screen_all(self, trees: list[Expr], batch: int = 16) -> list[Outcome]:
        outcomes: list[Outcome | None] = []
        todo: list[tuple[int, Expr, Expr, int]] = []
        for tree in trees:
            self.report.seen += 1
            if tree.digest in self.exprs:
                self.report.structural_duplicates += 1
                outcomes.append(Outcome(tree, tree.digest, Verdict.KILLED, Stage.GENERATED, KillReason.DUPLICATE, logged=False))
                continue
            self.exprs.add(tree.digest)
            body, gone = strip_elidable_root(tree)
            self.report.elided_nodes += gone
            todo.append((len(outcomes), tree, body, gone))
            outcomes.append(None)
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            bodies = [body for _, _, body, _ in part]
            measured, hashes = self._measured(bodies)
            for i, (place, tree, _, gone) in enumerate(part):
                outcomes[place] = self._judge(tree, measured[i], hashes.get(i), gone)
        return outcomes

    def _measured(self, bodies: list[Expr]) -> tuple[list[dict | None], dict[int, str]]:
        """Metrics and identities of a batch; where a batch fails, each candidate for itself, None for those that fail alone."""
        try:
            return measure(self.panel, bodies, self.config.horizon, self.forward, self.strict), value_hashes(ranked_signals(self.panel, bodies, self.strict), *self.shape)
        except (ValueError, ArithmeticError, PySparkException, Py4JJavaError):
            if len(bodies) == 1:
                return [None], {}
        alone = [self._measured([body]) for body in bodies]
        return [m for found, _ in alone for m in found], {i: names[0] for i, (_, names) in enumerate(alone) if 0 in names}

    def _judge(self, tree: Expr, m: dict | None, digest: str | None, gone: int) -> Outcome:
        if m is None:
            return self._log(tree, KillReason.ERROR, None, None, gone)
        early = unfit(m, self.config)
        if early is not None:
            return self._log(tree, early, None, m, gone)
        if digest in self.values:
            self.report.semantic_collapses += 1
            return Outcome(tree, tree.digest, Verdict.KILLED, Stage.SCREENED, KillReason.DUPLICATE, digest, m, False, gone)
        if digest:
            self.values[digest] = tree.digest
        return self._log(tree, scored_verdict(m, self.config), digest, m, gone)

    def _log(self, tree: Expr, reason: KillReason | None, digest: str | None, m: dict | None, gone: int) -> Outcome:
        verdict = Verdict.PASSED if reason is None else Verdict.KILLED
        if reason is None:
            self.report.passed += 1
        else:
            self.report.kills[reason.value] += 1
        ic = _finite(m["ic"]) if m else None
        sign = None if ic is None else (ic > 0) - (ic < 0)
        self.ledger.log_trial(Trial(self.run_id, tree.digest, str(tree), verdict, Stage.SCREENED, reason, digest, ic, _finite(m["ic_ir"]) if m else None, sign, _finite(m["turnover"]) if m else None))
        self.report.logged += 1
        return Outcome(tree, tree.digest, verdict, Stage.SCREENED, reason, digest, m, True, gone)
