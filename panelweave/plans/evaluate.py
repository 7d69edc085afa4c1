"""Evaluation results, their diagnostics, and the semantic identity of signals."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.expr import Expr
from .compiler import AXES, column_of, compile_trees, count_column_of


@dataclass(frozen=True)
class Evaluation:
    """values: axes and v. nodes: digest, expr, degradation of each windowed node. non_finite: infinite root cells. clamped: always 0 (moments are updated, not subtracted)."""

    tree: Expr
    values: DataFrame
    degradation: dict[str, float]
    non_finite: int
    clamped: int = 0

    @property
    def max_degradation(self) -> float:
        return max(self.degradation.values(), default=0.0)

    @property
    def worst_node(self) -> tuple[str, float]:
        return max(self.degradation.items(), key=lambda x: x[1], default=("", 0.0))


def _windowed(trees: list[Expr]) -> list[Expr]:
    seen = {n.digest: n for t in trees for n in t.walk() if catalog.min_periods(n.spec, n.params[0] if n.params else 0) is not None}
    return list(seen.values())


def diagnostics(panel: DataFrame, trees: list[Expr], strict: bool = False) -> DataFrame:
    """One row: bad_i (infinite root cells of tree i) and deg_j (share of windowed node j's results from incomplete windows)."""
    done = compile_trees(panel, trees, strict=strict, counts=True)
    inf, out = F.lit(float("inf")), []
    for i, t in enumerate(trees):
        raw = F.col(f"raw_{column_of(t)}") if not t.is_field else F.col(column_of(t))
        out.append(F.count_if(F.abs(raw) == inf).alias(f"bad_{i}"))
    for j, n in enumerate(_windowed(trees)):
        made = F.col(column_of(n)).isNotNull()
        share = F.try_divide(F.count_if(made & (F.col(count_column_of(n)) < n.params[0])), F.count_if(made))
        out.append(F.coalesce(share, F.lit(0.0)).alias(f"deg_{j}"))
    return done.agg(*out)


def evaluate(panel: DataFrame, tree: Expr, strict: bool = False) -> Evaluation:
    return evaluate_batch(panel, [tree], strict)[0]


def evaluate_batch(panel: DataFrame, trees: list[Expr], strict: bool = False) -> list[Evaluation]:
    """Values stay distributed; the diagnostics of the whole batch are one small row."""
    done = compile_trees(panel, trees, strict=strict)
    row, nodes = diagnostics(panel, trees, strict).first(), _windowed(trees)
    share = {n.digest: row[f"deg_{j}"] for j, n in enumerate(nodes)}
    return [
        Evaluation(t, done.select(*AXES, F.col(column_of(t)).alias("v")), {str(n): share[n.digest] for n in t.walk() if n.digest in share}, row[f"bad_{i}"])
        for i, t in enumerate(trees)
    ]


def window_fill(panel: DataFrame, node: Expr) -> DataFrame:
    """Axes and fill: present share of each window of a windowed node (its first child), from its warmup on."""
    from .compiler import history

    d, child = node.params[0], node.children[0]
    done = compile_trees(panel, [child], finite=False)
    count = F.count(column_of(child)).over(history().rowsBetween(-(d - 1), 0))
    return done.select(*AXES, F.when(F.col("t") >= node.warmup, count / d).alias("fill"))


# --- identity --------------------------------------------------------------------------------


def orientation(ranks: DataFrame) -> DataFrame:
    """k, sign: of the first non-zero rank by session and instrument; 1 where all are zero."""
    off = F.col("p2") != F.col("n") - 1
    first = F.min_by(F.when(F.col("p2") > F.col("n") - 1, 1).otherwise(-1), F.when(off, F.struct("t", "inst_idx")))
    return ranks.groupBy("k").agg(F.coalesce(F.when(F.count_if(off) > 0, first), F.lit(1)).alias("sign"))


def rank_positions(ranks: DataFrame) -> DataFrame:
    """k, t, inst_idx, position: doubled whole positions, mirrored where the signal's orientation is negative.

    A signal, its negation and any rescaling that keeps each session's order give the same positions.
    """
    oriented = ranks.join(F.broadcast(orientation(ranks)), "k")
    mirrored = F.when(F.col("sign") < 0, 2 * (F.col("n") - 1) - F.col("p2")).otherwise(F.col("p2"))
    return oriented.select("k", "t", "inst_idx", mirrored.alias("position"))


def value_hashes(ranks: DataFrame, sessions: int, instruments: int) -> dict[int, str]:
    """Identity of each signal: a hash over the grid's shape and every session's oriented positions.

    Sessions are digested on the executors; the driver folds one digest per signal and session.
    """
    days = rank_positions(ranks).groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("inst_idx", "position"))).alias("cells"))
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["inst_idx"].cast("string"), c["position"].cast("string"))), ",")
    digests: dict[int, hashlib._Hash] = {}
    for r in days.select("k", "t", F.sha2(text, 256).alias("h")).orderBy("k", "t").toLocalIterator():
        if r["k"] not in digests:
            digests[r["k"]] = hashlib.sha256(f"{sessions}x{instruments}".encode())
        digests[r["k"]].update(f"|{r['t']}:{r['h']}".encode())
    return {k: d.hexdigest()[:32] for k, d in digests.items()}
