"""Panels: dense (session x instrument) grids, from tables or from the parquet layout."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a panel and the layout's columns.
PRICE_FIELDS = ("open", "high", "low", "close", "vwap")
VALUE_FIELDS = ("open", "high", "low", "close", "vwap", "volume", "returns", "mcap", "adj_factor")
TRADING_FIELDS = ("lot_size", "can_short", "borrow_cost", "band_upper", "band_lower", "surveillance_flag", "halted", "is_listed", "index_membership")
GROUP_FIELDS = ("sector",)
FIELDS = (*VALUE_FIELDS, *TRADING_FIELDS, *GROUP_FIELDS)
BOOLEAN_FIELDS = ("can_short", "surveillance_flag", "halted", "is_listed")


class PanelError(ValueError):
    """A panel breaks one of its invariants."""


class LayoutError(FileNotFoundError):
    """The parquet layout lacks a required table."""


@dataclass(frozen=True)
class Panel:
    """A dense grid: t, date, inst, inst_idx and fields as DOUBLE, missing as NULL."""

    df: DataFrame

    def head(self, k: int) -> Panel:
        """The first k sessions."""
        return Panel(self.df.where(F.col("t") < k))

    def shape(self) -> tuple[int, int]:
        r = self.df.agg((F.max("t") + 1).alias("n"), F.countDistinct("inst").alias("m")).first()
        return r["n"] or 0, r["m"]

    def cache(self) -> Panel:
        return Panel(self.df.cache())

    def problems(self) -> DataFrame:
        """One row per broken invariant: problem, cells."""
        df = self.df
        missing = [f for f in FIELDS if f not in df.columns]
        listed = F.coalesce(F.col("is_listed"), F.lit(0.0)) == 1
        by = Window.partitionBy("inst").orderBy("t")
        starts = listed & ~F.lag(listed, 1, False).over(by)
        inf = F.lit(float("inf"))
        odd = [F.count_if(F.isnan(c) | (F.abs(c) == inf)).alias(f"inf_{c}") for c in df.columns if c in FIELDS]
        one = df.withColumn("start", starts.cast("int")).agg(
            F.count_if(~F.coalesce(F.col("is_listed").isin(0.0, 1.0), F.lit(False))).alias("is_listed must be 0 or 1, never missing"),
            F.count_if(~listed & F.coalesce(*[F.col(p) for p in PRICE_FIELDS]).isNotNull()).alias("prices on unlisted cells, carried forward"),
            *odd,
        )
        runs = df.withColumn("start", starts.cast("int")).groupBy("inst").agg(F.sum("start").alias("runs"))
        relisted = runs.agg(F.count_if(F.col("runs") > 1).alias("cells")).select(F.lit("instruments that relist").alias("problem"), "cells")
        grid = df.agg((F.count("*") - (F.max("t") + 1) * F.countDistinct("inst")).alias("gap"), (F.count("*") - F.countDistinct("t", "inst")).alias("twice"))
        dense = grid.select(F.lit("cells missing from or repeated in the grid").alias("problem"), (F.abs("gap") + F.col("twice")).alias("cells"))
        names = [c for c in one.columns if not c.startswith("inf_")]
        infinite = one.select(F.lit("infinity in a field").alias("problem"), sum((F.col(c) for c in one.columns if c.startswith("inf_")), F.lit(0)).alias("cells"))
        out = relisted.unionByName(dense).unionByName(infinite)
        for c in names:
            out = out.unionByName(one.select(F.lit(c).alias("problem"), F.col(f"`{c}`").alias("cells")))
        if missing:
            spark = df.sparkSession
            out = out.unionByName(spark.range(1).select(F.lit(f"missing fields {missing}").alias("problem"), F.lit(1).cast("long").alias("cells")))
        return out.where("cells > 0")

    def validate(self) -> None:
        missing = [f for f in FIELDS if f not in self.df.columns]
        unknown = [c for c in self.df.columns if c not in (*FIELDS, "t", "date", "inst", "inst_idx")]
        if missing or unknown:
            raise PanelError(f"missing fields {missing}, unknown fields {unknown}")
        found = self.problems().limit(20).collect()
        if found:
            raise PanelError("; ".join(f"{r['problem']}: {r['cells']}" for r in found))


def densify(bars: DataFrame, sessions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every (session, instrument) cell with the bars' fields; a cell without a bar is unlisted.

    bars: date, inst and fields. sessions: date. The two axes are small; their product meets the bars by an equi-join.
    """
    days = sessions.select("date").distinct()
    by_date = Window.orderBy("date")
    days = days.withColumn("t", F.row_number().over(by_date) - 1)
    names = bars.select("inst").distinct().withColumn("inst_idx", F.row_number().over(Window.orderBy("inst")) - 1)
    marked = bars.select("date", "inst", *fields).withColumn("is_listed", F.lit(1.0))
    grid = days.crossJoin(names).join(marked, ["date", "inst"], "left")
    return grid.withColumn("is_listed", F.coalesce("is_listed", F.lit(0.0))).select("t", "date", "inst", "inst_idx", *fields, "is_listed")


def nudged(x, digits: int = 4):
    """Round by a floor away from one half: decimals of the tables' kind never end at the border."""
    unit = 10.0**digits
    return F.floor(x * unit + 0.37193518) / unit


def weekly_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """The panel of weeks x suppliers of the order-line tables.

    A week's price is turnover over quantity; open is the first price of the week, mcap stands in
    as price times volume, sector is the supplier's region. Prices are rounded to four digits, so
    that the order in which a cluster adds them doesn't matter.
    """
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    bars = (
        read("lineitem")
        .where("l_quantity > 0")
        .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_suppkey").cast("string").alias("inst"))
        .agg(
            nudged(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            nudged(F.max(price)).alias("high"),
            nudged(F.min(price)).alias("low"),
            nudged(F.min_by(price, first)).alias("open"),
            nudged(F.sum("l_quantity")).alias("volume"),
        )
        .withColumn("vwap", F.col("close"))
        .withColumn("mcap", nudged(F.col("close") * F.col("volume")))
    )
    fields = ("open", "high", "low", "close", "vwap", "volume", "mcap")
    grid = densify(bars, bars.select("date"), fields)
    past = F.lag("close", 1).over(Window.partitionBy("inst").orderBy("t"))
    grid = grid.withColumn("returns", nudged(F.when(F.abs(past) > 1e-10, F.col("close") / past) - 1, 6))
    regions = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    regions = regions.select(F.col("s_suppkey").cast("string").alias("inst"), F.col("n_regionkey").cast("int").alias("sector"))
    return Panel(grid.join(regions, "inst", "left").select("t", "date", "inst", "inst_idx", *fields, "returns", "sector", "is_listed"))


# --- the parquet layout ----------------------------------------------------------------------

BARS = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("instrument_id", T.StringType())]
    + [T.StructField(c, T.FloatType()) for c in ("open", "high", "low", "close", "volume", "vwap", "returns", "mcap", "adj_factor", "borrow_cost", "band_upper", "band_lower")]
    + [T.StructField(c, T.IntegerType()) for c in ("sector", "lot_size", "index_membership")]
    + [T.StructField(c, T.BooleanType()) for c in ("can_short", "surveillance_flag", "halted")]
)


@dataclass(frozen=True)
class CostModel:
    """Cost of a trade in basis points: commission, half the spread, and impact by the root of participation."""

    commission_bps: float
    half_spread_bps: float
    impact_coef: float

    def trade_cost_bps(self, rate):
        """As a column of a participation rate column; a negative rate is an error, a missing one missing."""
        rate = F.col(rate) if isinstance(rate, str) else rate
        return F.when(rate < 0, F.raise_error(F.lit("participation rate must not be negative")).cast("double")).otherwise(
            F.lit(self.commission_bps) + F.lit(self.half_spread_bps) + F.lit(self.impact_coef) * F.sqrt(rate)
        )


def duplicate_bars(bars: DataFrame) -> DataFrame:
    """date, instrument_id, count of keys that stand more than once."""
    return bars.groupBy("date", "instrument_id").count().where("count > 1")


def dates_off_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dates of bars that are no sessions."""
    return bars.select("date").distinct().join(calendar.select("date").distinct(), "date", "left_anti")


def describe(panel: Panel, delistings: DataFrame) -> DataFrame:
    """One row: sector changes per instrument-year, whether sectors look point-in-time, delistings, halted and listed shares."""
    df, by = panel.df, Window.partitionBy("inst").orderBy("t")
    known = df.where("is_listed = 1 AND sector IS NOT NULL").withColumn("changed", (F.col("sector") != F.lag("sector").over(by)).cast("int"))
    moved = known.groupBy("inst").agg(F.coalesce(F.max("changed"), F.lit(0)).alias("changed")).agg(F.avg("changed").alias("share"))
    span = df.agg(((F.max("t") + 1) / 252).alias("years"), F.avg("halted").alias("halted_share"), F.avg("is_listed").alias("listed_share"))
    gone = delistings.join(df.select("inst").distinct(), F.col("instrument_id") == F.col("inst"), "left_semi").agg(F.count("*").alias("n_delisted"))
    out = span.crossJoin(moved).crossJoin(gone)
    rate = F.coalesce(F.col("share") / F.col("years"), F.lit(0.0))
    return out.select(rate.alias("reclassified_per_year"), ((rate > 0.001) | (F.col("years") < 3)).alias("point_in_time"), "n_delisted", "halted_share", "listed_share", "years")


class LayoutAdapter:
    """Panels from a folder with bars/year=Y, reference/delistings, costs/costs and calendar/sessions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: T.StructType | None = None) -> DataFrame:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.root}/{path}")
        except Exception as e:
            raise LayoutError(f"{self.root}/{path} can't be read: {str(e)[:200]}") from e

    def bars(self, start=None, end=None) -> DataFrame:
        """Bars between two dates (inclusive); the year predicate prunes partitions."""
        df = self._read("bars")
        lacking = [f.name for f in BARS if f.name not in df.columns]
        if lacking:
            raise LayoutError(f"bars lack columns {lacking}")
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                day = F.lit(str(bound)).cast("date")
                df = df.where(getattr(F.col("date"), op)(day))
                if "year" in df.columns:
                    df = df.where(getattr(F.col("year"), op)(F.year(day)))
        return df.drop("year")

    def calendar(self) -> DataFrame:
        return self._read("calendar/sessions.parquet").select("date").distinct().orderBy("date")

    def delistings(self) -> DataFrame:
        return self._read("reference/delistings.parquet")

    def costs(self) -> CostModel:
        rows = self._read("costs/costs.parquet").where("instrument_id IS NULL").orderBy("date").limit(1).collect()
        if not rows:
            raise PanelError("costs have no default row")
        return CostModel(*(float(rows[0][c]) for c in ("commission_bps", "half_spread_bps", "impact_coef")))

    def duplicates(self, bars: DataFrame) -> DataFrame:
        return duplicate_bars(bars)

    def look_ahead(self) -> DataFrame:
        """Bars known only after their date; checked over all rows, whatever the range."""
        bars = self._read("bars")
        return bars.where("knowledge_date > date") if "knowledge_date" in bars.columns else bars.limit(0)

    def off_calendar(self, bars: DataFrame) -> DataFrame:
        return dates_off_calendar(bars, self.calendar())

    def panel(self, start=None, end=None, check: bool = True) -> Panel:
        """The dense panel of a date range, with delisting returns composed into the last listed row."""
        if start is not None and end is not None and str(start) > str(end):
            raise PanelError("the start lies after the end")
        bars = self.bars(start, end)
        if check:
            if not bars.take(1):
                raise PanelError("there are no bars in this range")
            for rows, what in ((self.look_ahead(), "look-ahead: bars known after their date"), (self.duplicates(bars), "duplicate bars"), (self.off_calendar(bars), "dates that are not trading sessions")):
                if rows.take(1):
                    raise PanelError(f"{what}, such as {rows.first().asDict()}")
        double = [F.coalesce(F.col(c), F.lit(False)).cast("double").alias(c) if c in BOOLEAN_FIELDS else F.col(c).cast("int" if c == "sector" else "double").alias(c) for c in FIELDS if c != "is_listed"]
        cells = bars.select("date", F.col("instrument_id").alias("inst"), *double)
        sessions = self.calendar()
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                sessions = sessions.where(getattr(F.col("date"), op)(F.lit(str(bound)).cast("date")))
        grid = densify(cells, sessions, tuple(f for f in FIELDS if f != "is_listed"))
        constant = {c: F.coalesce(F.col(c), F.when(F.col("is_listed") == 1, F.lit(v))) for c, v in (("lot_size", 1.0),)}
        flags = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in BOOLEAN_FIELDS}
        return Panel(compose_delistings(grid.withColumns(constant | flags), self.delistings(), check))

    def diagnostics(self, panel: Panel) -> DataFrame:
        return describe(panel, self.delistings())


def compose_delistings(grid: DataFrame, delistings: DataFrame, check: bool = True) -> DataFrame:
    """Compose each delisting return into its instrument's last listed row.

    It applies where the delisting falls inside the grid's dates and the last listed row is on
    or before it; an instrument with bars after its delisting is an error.
    """
    terminal = delistings.select(F.col("instrument_id").alias("inst"), F.col("delist_date"), F.col("delist_return").cast("double").alias("delist_return"))
    last = grid.where("is_listed = 1").groupBy("inst").agg(F.max("t").alias("last_t"), F.max("date").alias("last_date"))
    known = last.join(terminal, "inst")
    if check:
        late = known.where("last_date > delist_date").limit(1).collect()
        if late:
            raise PanelError(f"{late[0]['inst']} has bars after its delisting")
    end = grid.agg(F.max("date").alias("end"))
    known = known.crossJoin(end).where("delist_date <= end").select("inst", "last_t", "delist_return")
    r, d = F.col("returns"), F.col("delist_return")
    composed = F.when(d.isNull(), r).when(r.isNull(), d).otherwise((1 + r) * (1 + d) - 1)
    out = grid.join(known, "inst", "left")
    return out.withColumn("returns", F.when(F.col("t") == F.col("last_t"), composed).otherwise(r)).select(*grid.columns)


def write_layout(panel: Panel, root: str, delistings: DataFrame | None = None, costs: CostModel | None = None) -> str:
    """Write a panel as the parquet layout: listed cells by year, reference, costs and calendar."""
    spark, df = panel.df.sparkSession, panel.df
    listed = df.where("is_listed = 1").withColumn("instrument_id", F.col("inst")).withColumn("year", F.year("date"))
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns or f.name == "instrument_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in BARS]
    listed.select(*columns, "year").write.mode("overwrite").partitionBy("year").parquet(f"{root}/bars")
    if delistings is None:
        delistings = spark.createDataFrame([], "instrument_id string, delist_date date, delist_return float, delist_code int")
    delistings.write.mode("overwrite").parquet(f"{root}/reference/delistings.parquet")
    seen = df.where("is_listed = 1").groupBy(F.col("inst").alias("instrument_id")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    seen.write.mode("overwrite").parquet(f"{root}/reference/instruments.parquet")
    c = costs or CostModel(1.0, 2.5, 10.0)
    row = [(None, None, c.commission_bps, c.half_spread_bps, c.impact_coef)]
    spark.createDataFrame(row, "instrument_id string, date date, commission_bps double, half_spread_bps double, impact_coef double").write.mode("overwrite").parquet(f"{root}/costs/costs.parquet")
    df.select("date", F.lit(False).alias("is_half")).distinct().write.mode("overwrite").parquet(f"{root}/calendar/sessions.parquet")
    return root


# --- cache and identity ----------------------------------------------------------------------

CACHE_VERSION = 1


def write_cache(panel: Panel, path: str) -> str:
    """Keep a panel as one parquet table with a version column; later reads take only the columns they use."""
    panel.df.withColumn("cache_version", F.lit(CACHE_VERSION)).write.mode("overwrite").parquet(path)
    return path


def read_cache(spark: SparkSession, path: str) -> Panel:
    df = spark.read.parquet(path)
    if "cache_version" not in df.columns:
        raise PanelError("not a panel cache")
    found = df.select("cache_version").limit(1).collect()
    if found and found[0][0] != CACHE_VERSION:
        raise PanelError(f"cache version {found[0][0]}, expected {CACHE_VERSION}")
    return Panel(df.drop("cache_version"))


def snapshot_id(panel: Panel) -> str:
    """A 32-digit name of the panel's axes and every field; it doesn't depend on partitioning.

    Rows are digested on the executors, then sessions; the driver gets one digest per session.
    """
    fields = [c for c in panel.df.columns if c not in ("t", "date", "inst", "inst_idx")]
    shown = [F.coalesce(F.col(c).cast("double").cast("string"), F.lit("-")) for c in fields]
    row = F.sha2(F.concat_ws("|", F.col("inst"), *shown), 256)
    days = panel.df.select("t", "date", F.struct(F.col("inst_idx"), row.alias("h")).alias("s")).groupBy("t", "date").agg(F.array_sort(F.collect_list("s")).alias("s"))
    days = days.select("t", F.sha2(F.concat_ws("|", F.col("date").cast("string"), F.transform("s", lambda s: s["h"])), 256).alias("h")).orderBy("t")
    digest = hashlib.sha256(json.dumps(fields).encode())
    for r in days.toLocalIterator():
        digest.update(r["h"].encode())
    return digest.hexdigest()[:32]
