"""Monthly factor files: text with a preamble, monthly rows of percentages, and other tables after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_monthly_factor(spark: SparkSession, path: str) -> DataFrame:
    """month (first day) and factor (a fraction) of the rows that begin with six digits; the first row of a month counts."""
    lines = spark.read.text(path).select(F.split("value", r"\s*,\s*").alias("p"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where(F.trim(F.col("p")[0]).rlike("^[0-9]{6}$") & (F.size("p") >= 2))
    month = F.to_date(F.concat(F.trim(F.col("p")[0]), F.lit("01")), "yyyyMMdd")
    value = F.expr("try_cast(trim(p[1]) AS DOUBLE)") / 100
    return rows.select(month.alias("month"), value.alias("factor"), "at").groupBy("month").agg(F.min_by("factor", "at").alias("factor"))
