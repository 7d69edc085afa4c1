"""Compile expression trees to staged DataFrame windows.

All trees of a batch become one graph keyed by structural hash, so a shared subtree is one
column. Nodes are emitted level by level: a level depends only on earlier ones, and within a
level history nodes (partitioned by instrument) and session nodes (partitioned by t) are
separate selects, so chained windows of one axis share an exchange and a sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.expr import Expr

#: Columns that place a cell; everything else is a field or a node.
AXES = ("t", "date", "inst", "inst_idx")


def column_of(node: Expr) -> str:
    """Name of a node's column; fields keep theirs."""
    return node.op if node.is_field else f"n_{node.digest[:16]}"


def count_column_of(node: Expr) -> str:
    """Name of the column with the present values in a windowed node's window."""
    return f"m_{node.digest[:16]}"


def history() -> Window:
    return Window.partitionBy("inst").orderBy("t")


def _session(*keys: str) -> Window:
    """A session's cells in one fixed order, so that sums don't depend on the shuffle."""
    return Window.partitionBy("t", *keys).orderBy("inst_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def centred_rank(x: Column, *keys: str) -> Column:
    """(position + 1/2) / n - 1/2 among the present values of a session (or of its group)."""
    return (doubled_position(x, *keys) / 2 + 0.5) / F.count(x).over(Window.partitionBy("t", *keys)) - 0.5


def doubled_position(x: Column, *keys: str) -> Column:
    """Twice the average position, from 0: a whole number, so no rounding can split a tie."""
    below = F.rank().over(Window.partitionBy("t", *keys, x.isNull()).orderBy(x)) - 1
    ties = F.count(x).over(Window.partitionBy("t", *keys, x))
    return F.when(x.isNotNull(), 2 * below + ties - 1)


def _elementwise(op: str, x: Column, y: Column | None) -> Column:
    if op == "add":
        return x + y
    if op == "sub":
        return x - y
    if op == "mul":
        return x * y
    if op == "div":
        return F.when(F.abs(y) > catalog.DIV_EPS, x / y)
    if op == "log":
        return F.when(x > 0, F.ln(x))
    return {"abs": F.abs, "sign": F.signum}[op](x)


def _cross(op: str, x: Column, group: str | None) -> Column:
    if op == "rank":
        return F.when(x.isNotNull(), centred_rank(x))
    if op == "zscore":
        every = _session()
        spread = F.stddev_samp(x).over(every)
        return F.when((F.count(x).over(every) > 1) & (spread > 0), (x - F.avg(x).over(every)) / spread)
    every = _session(group)
    enough = F.col(group).isNotNull() & (F.count(x).over(every) >= catalog.MIN_GROUP_SIZE) & x.isNotNull()
    if op == "demean_by":
        return F.when(enough, x - F.avg(x).over(every))
    return F.when(enough, centred_rank(x, group))


def _rolling(node: Expr, x: Column, y: Column | None) -> tuple[Column, Column]:
    """Value and present count of a windowed node."""
    d = node.params[0]
    window = history().rowsBetween(-(d - 1), 0)
    over = lambda c: c.over(window)
    t = F.col("t")
    if node.op == "correlation":
        pair = x.isNotNull() & y.isNotNull()
        x, y = F.when(pair, x), F.when(pair, y)
    m = over(F.count(x))
    least = catalog.min_periods(node.spec, d)
    if node.op in ("ts_std", "correlation"):
        least = max(least, 2)
    ready = (t >= node.warmup) & (m >= least)
    if node.op == "ts_mean":
        value = over(F.avg(x))
    elif node.op == "ts_std":
        value = over(F.stddev_samp(x))
    elif node.op == "ts_min":
        value = over(F.min(x))
    elif node.op == "ts_max":
        value = over(F.max(x))
    elif node.op == "ts_argmax":
        value = (t - over(F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), t.alias("at")))))["at"]).cast("double")
    elif node.op == "decay_linear":
        oldest = t - d
        weights = over(F.sum(F.when(x.isNotNull(), t))) - oldest * m
        value = F.try_divide(over(F.sum(x * t)) - oldest * over(F.sum(x)), weights.cast("double"))
    elif node.op == "ts_rank":
        present = over(F.collect_list(x))
        # Twice the rank less one: two for each smaller value, one for each equal one.
        doubled = F.aggregate(present, F.lit(0), lambda n, v: n + F.when(v < x, 2).when(v == x, 1).otherwise(0))
        value, ready = (doubled + 1) / (2 * m), ready & x.isNotNull()
    else:
        across = F.sqrt(over(F.var_pop(x)) * over(F.var_pop(y)))
        # greatest and least skip nulls, so the guard stands outside.
        value = F.when(across > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), over(F.covar_pop(x, y)) / across)))
    return F.when(ready, value), m


def node_columns(node: Expr, counts: bool) -> list[Column]:
    """The columns of one node, in terms of its children's."""
    x = F.col(column_of(node.children[0]))
    second = column_of(node.children[1]) if len(node.children) > 1 else None
    spec, name = node.spec, column_of(node)
    if spec.axis == catalog.CELL:
        return [_elementwise(node.op, x, F.col(second) if second else None).alias(name)]
    if spec.axis == catalog.SESSION:
        return [_cross(node.op, x, second).alias(name)]
    if spec.reach == catalog.POINT:
        past = F.lag(x, node.params[0]).over(history())
        return [(past if node.op == "ts_delay" else x - past).alias(name)]
    value, m = _rolling(node, x, F.col(second) if second else None)
    return [value.alias(name), m.alias(count_column_of(node))] if counts else [value.alias(name)]


def graph(trees: Iterable[Expr]) -> list[list[Expr]]:
    """Distinct inner nodes of all trees by level; a level holds one axis."""
    level: dict[str, int] = {}
    node_of: dict[str, Expr] = {}

    def visit(node: Expr) -> int:
        if node.is_field:
            return 0
        if node.digest not in level:
            below = max(map(visit, node.children))
            axis = (catalog.CELL, catalog.HISTORY, catalog.SESSION).index(node.spec.axis)
            level[node.digest], node_of[node.digest] = below + 1 + (axis - (below + 1)) % 3, node
        return level[node.digest]

    for tree in trees:
        visit(tree)
    out: dict[int, list[Expr]] = {}
    for digest, n in level.items():
        out.setdefault(n, []).append(node_of[digest])
    return [out[n] for n in sorted(out)]


def compile_trees(panel: DataFrame, trees: Iterable[Expr], *, strict: bool = False, counts: bool = False, finite: bool = True, width: int = 30) -> DataFrame:
    """The panel with a column for every node of the trees.

    panel: AXES and DOUBLE fields on a dense grid, missing as NULL. strict: round every node to
    single precision. counts: also keep windowed nodes' present counts. finite: make an infinite
    root missing. width: nodes of a select at most.
    """
    trees = list(trees)
    missing = {n.op for t in trees for n in t.walk() if n.is_field} - set(panel.columns)
    if missing:
        raise ValueError(f"the panel lacks fields {sorted(missing)}")
    out = panel
    for nodes in graph(trees):
        for at in range(0, len(nodes), width):
            new = [c for node in nodes[at : at + width] for c in node_columns(node, counts)]
            out = out.select("*", *new)
            if strict:
                names = [column_of(n) for n in nodes[at : at + width]]
                out = out.withColumns({n: F.col(n).cast("float").cast("double") for n in names})
    if finite:
        roots = {column_of(t) for t in trees if not t.is_field}
        inf = F.lit(float("inf"))
        out = out.withColumns({f"raw_{r}": F.col(r) for r in roots} | {r: F.when(F.abs(F.col(r)) < inf, F.col(r)) for r in roots}) if roots else out
    return out


def values_of(panel: DataFrame, trees: list[Expr], *, strict: bool = False) -> DataFrame:
    """Only the axes and v0, v1, ...: the trees' values."""
    done = compile_trees(panel, trees, strict=strict)
    return done.select(*AXES, *[F.col(column_of(t)).alias(f"v{i}") for i, t in enumerate(trees)])


def long_form(values: DataFrame, n: int) -> DataFrame:
    """Values of n trees as rows (k, t, date, inst, inst_idx, v), missing ones left out: one sort ranks them all."""
    pairs = F.posexplode(F.array(*[F.col(f"v{i}").cast("double") for i in range(n)])).alias("k", "v")
    return values.select(*AXES, pairs).where("v IS NOT NULL")
