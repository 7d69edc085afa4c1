"""DuckDB SQL of panels, expressions and scores, written apart from the Spark plans it checks."""

from __future__ import annotations

from .functions import catalog
from .functions.expr import Expr, from_string

#: Added before the floor that rounds. No quotient or product of the tables' decimals ends there, so no
#: value can fall to either side by the order of a sum, as it does at one half.
NUDGE = 0.37193518


def tie_safe(sql: str) -> str:
    """`round(x, n)` as a floor that is nudged."""
    while (at := sql.find("round(")) >= 0:
        depth, i, comma = 1, at + 6, 0
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        unit = f"1e{int(sql[comma + 1 : i - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {unit} + {NUDGE}) / {unit}){sql[i:]}"
    return sql


PANEL = """
bars AS (
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS inst,
        round(sum(l_extendedprice) / sum(l_quantity), 4) AS close,
        round(max(l_extendedprice / l_quantity), 4) AS high, round(min(l_extendedprice / l_quantity), 4) AS low,
        round(arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)), 4) AS open,
        round(sum(l_quantity), 4) AS volume
    FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2
),
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
names AS (SELECT inst, CAST(row_number() OVER (ORDER BY inst) - 1 AS INTEGER) AS inst_idx FROM (SELECT DISTINCT inst FROM bars)),
grid AS (
    SELECT days.t, days.date, names.inst, names.inst_idx, open, high, low, close, close AS vwap, volume,
        round(close * volume, 4) AS mcap, CASE WHEN bars.inst IS NULL THEN 0.0 ELSE 1.0 END AS is_listed
    FROM days CROSS JOIN names LEFT JOIN bars ON bars.date = days.date AND bars.inst = names.inst
),
moved AS (SELECT *, lag(close) OVER (PARTITION BY inst ORDER BY t) AS past FROM grid),
panel AS (
    SELECT moved.* EXCLUDE (past), round(CASE WHEN abs(past) > 1e-10 THEN close / past END - 1, 6) AS returns, CAST(n_regionkey AS INTEGER) AS sector
    FROM moved LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = inst LEFT JOIN nation ON s_nationkey = n_nationkey
)"""


def _value(node: Expr, name: dict[str, str]) -> list[str]:
    """Layers of (column definitions) that add this node's column to a table that has its children's."""
    x = name[node.children[0].digest]
    y = name[node.children[1].digest] if len(node.children) > 1 else ""
    out, d = name[node.digest], node.params[0] if node.params else 0
    hist = "PARTITION BY inst ORDER BY t"
    win = f"({hist} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    ready = f"t >= {node.warmup} AND count({x}) OVER {win} >= {catalog.min_periods(node.spec, d) or 0}"
    rank = lambda keys: (
        f"((rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) - 1) + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 + 0.5)"
        f" / count({x}) OVER (PARTITION BY {keys}) - 0.5"
    )
    simple = {
        "add": f"{x} + {y}", "sub": f"{x} - {y}", "mul": f"{x} * {y}", "div": f"CASE WHEN abs({y}) > 1e-10 THEN {x} / {y} END",
        "log": f"CASE WHEN {x} > 0 THEN ln({x}) END", "abs": f"abs({x})", "sign": f"CAST(sign({x}) AS DOUBLE)",
        "ts_delay": f"lag({x}, {d}) OVER ({hist})", "delta": f"{x} - lag({x}, {d}) OVER ({hist})",
        "ts_mean": f"CASE WHEN {ready} THEN avg({x}) OVER {win} END",
        "ts_std": f"CASE WHEN {ready} AND count({x}) OVER {win} >= 2 THEN stddev_samp({x}) OVER {win} END",
        "ts_min": f"CASE WHEN {ready} THEN min({x}) OVER {win} END", "ts_max": f"CASE WHEN {ready} THEN max({x}) OVER {win} END",
        "ts_argmax": f"CASE WHEN {ready} THEN CAST(t - (max(CASE WHEN {x} IS NOT NULL THEN {{'v': {x}, 'at': t}} END) OVER {win}).at AS DOUBLE) END",
        "rank": f"CASE WHEN {x} IS NOT NULL THEN {rank('t')} END",
        "zscore": f"CASE WHEN count({x}) OVER (PARTITION BY t) > 1 THEN ({x} - avg({x}) OVER (PARTITION BY t)) / nullif(stddev_samp({x}) OVER (PARTITION BY t), 0) END",
        "demean_by": f"CASE WHEN {y} IS NOT NULL AND count({x}) OVER (PARTITION BY t, {y}) >= 5 THEN {x} - avg({x}) OVER (PARTITION BY t, {y}) END",
        "rank_within": f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND count({x}) OVER (PARTITION BY t, {y}) >= 5 THEN {rank(f't, {y}')} END",
    }
    if node.op in simple:
        return [f"{simple[node.op]} AS {out}"]
    if node.op == "decay_linear":
        tops = " + ".join(f"coalesce({d - k} * lag({x}, {k}) OVER ({hist}), 0)" for k in range(d))
        weights = " + ".join(f"CASE WHEN lag({x}, {k}) OVER ({hist}) IS NOT NULL THEN {d - k} ELSE 0 END" for k in range(d))
        return [f"CASE WHEN {ready} THEN ({tops}) / nullif(CAST({weights} AS DOUBLE), 0) END AS {out}"]
    if node.op == "ts_rank":
        listed = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {win} AS l_{out}, count({x}) OVER {win} AS m_{out}"
        less, same = f"len(list_filter(l_{out}, lambda v: v < {x}))", f"len(list_filter(l_{out}, lambda v: v = {x}))"
        least = catalog.min_periods(node.spec, d)
        return [listed, f"CASE WHEN {x} IS NOT NULL AND t >= {node.warmup} AND m_{out} >= {least} THEN ({less} + ({same} + 1) / 2.0) / m_{out} END AS {out}"]
    if node.op == "correlation":
        px, py = f"px_{out}", f"py_{out}"
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        first = f"CASE WHEN {both} THEN {x} END AS {px}, CASE WHEN {both} THEN {y} END AS {py}"
        least = max(2, catalog.min_periods(node.spec, d))
        across = f"sqrt(var_pop({px}) OVER {win} * var_pop({py}) OVER {win})"
        second = f"covar_pop({px}, {py}) OVER {win} / nullif({across}, 0)"
        return [first, f"CASE WHEN t >= {node.warmup} AND count({px}) OVER {win} >= {least} AND {across} > 0 THEN greatest(-1.0, least(1.0, {second})) END AS {out}"]
    raise NotImplementedError(node.op)


def _trees(texts: list[str | Expr]) -> list[Expr]:
    return [t if isinstance(t, Expr) else from_string(t) for t in texts]


def with_values(texts: list[str | Expr], panel: str = PANEL) -> str:
    """WITH clauses whose last table, vals, is the panel with v0, v1, ... of the expressions."""
    trees = _trees(texts)
    name: dict[str, str] = {}
    layers, table = [], "panel"
    for tree in trees:
        for node in reversed(tree.nodes()):
            if node.digest in name:
                continue
            name[node.digest] = node.op if node.is_field else f"x{len(name)}"
            if not node.is_field:
                for columns in _value(node, name):
                    layers.append(f"s{len(layers)} AS (SELECT *, {columns} FROM {table})")
                    table = f"s{len(layers) - 1}"
    values = ", ".join(f"{name[t.digest]} AS v{i}" for i, t in enumerate(trees))
    layers.append(f"vals AS (SELECT *, {values} FROM {table})")
    return "WITH " + ",\n".join([panel.strip(), *layers])


def values_sql(text: str) -> str:
    return with_values([text]) + "\nSELECT t, inst, round(v0, 6) AS v FROM vals WHERE v0 IS NOT NULL"


def forward(horizon: int) -> str:
    growth = " * ".join(f"(1 + lead(returns, {k}) OVER (PARTITION BY inst ORDER BY t))" for k in range(1, horizon + 1))
    return f"fwd AS (SELECT t, inst, inst_idx, {growth} - 1 AS fwd FROM panel)"


def _rank(source: str, value: str, out: str) -> str:
    below, ties = f"rank() OVER (PARTITION BY k, t ORDER BY {value}) - 1", f"count(*) OVER (PARTITION BY k, t, {value}) - 1"
    return f"""{out} AS (
    SELECT *, 2 * ({below}) + ({ties}) AS p2, count(*) OVER (PARTITION BY k, t) AS n,
        (({below}) + ({ties}) / 2.0 + 0.5) / count(*) OVER (PARTITION BY k, t) - 0.5 AS r
    FROM {source})"""


def with_ranks(texts: list[str | Expr], horizon: int = 1) -> str:
    """WITH clauses up to ranks (k, t, inst, inst_idx, r, p2, n), franks (fr) and ics (k, t, ic)."""
    trees = _trees(texts)
    long = " UNION ALL ".join(f"SELECT {i} AS k, t, date, inst, inst_idx, v{i} AS v FROM vals WHERE v{i} IS NOT NULL AND t >= {t.warmup}" for i, t in enumerate(trees))
    return ",\n".join(
        [
            with_values(texts),
            forward(horizon),
            f"longv AS ({long})",
            _rank("longv", "v", "ranks"),
            "fl AS (SELECT 0 AS k, * FROM fwd WHERE fwd IS NOT NULL)",
            _rank("fl", "fwd", "franks"),
            """ics AS (
    SELECT a.k, a.t, count(*) AS n, covar_pop(a.r, b.r) / nullif(sqrt(var_pop(a.r) * var_pop(b.r)), 0) AS ic
    FROM ranks a JOIN franks b ON a.t = b.t AND a.inst = b.inst GROUP BY 1, 2 HAVING count(*) >= 20)""",
        ]
    )
