"""Small panels with chosen planes."""

import datetime
import math

from panelweave.sources.panel import FIELDS


def make_panel(spark, **planes):
    """A dense panel: each plane is a list of rows (sessions) of values; None is missing. Other fields are missing, all cells listed."""
    n, m = next((len(p), len(p[0])) for p in planes.values())
    start = datetime.date(2020, 1, 1)
    rows = []
    for t in range(n):
        for i in range(m):
            cell = {f: None for f in FIELDS} | {"is_listed": 1.0}
            for name, plane in planes.items():
                v = plane[t][i]
                cell[name] = None if v is None else int(v) if name == "sector" else float(v)
            rows.append((t, start + datetime.timedelta(days=t), f"I{i:04d}", i, *[cell[f] for f in FIELDS]))
    schema = "t int, date date, inst string, inst_idx int, " + ", ".join(f"{f} {'int' if f == 'sector' else 'double'}" for f in FIELDS)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def column(values):
    """One instrument over time."""
    return [[v] for v in values]


def table(df, value="v0"):
    """{(t, inst_idx): value} with missing as None."""
    return {(r["t"], r["inst_idx"]): None if r[value] is None or math.isnan(r[value]) else r[value] for r in df.collect()}
