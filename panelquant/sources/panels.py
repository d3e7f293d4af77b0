"""Panels of price bars built from tables of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelquant.functions.columns import ordered, rounded_mean, so_far

#: Bars as stored: one row a series and date.
BARS = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars in [start, end); the dates are pushed down to the scan."""
    reader = spark.read.schema(BARS)
    bars = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") < F.lit(end).cast("date"))
    return bars


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a series, one file in it for each writing task that has its rows."""
    bars.write.mode(mode).partitionBy("series_id").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_bars(rows: DataFrame, series: Column, by: Column) -> DataFrame:
    """Bars whose daily return is the day's mean discount less its centre; see FIXTURES.md."""
    daily = rows.groupBy(series.alias("series_id"), by.alias("date")).agg(
        (rounded_mean("l_discount", 6) - 0.05).alias("x"), F.avg("l_tax").alias("t"), F.sum("l_quantity").alias("q")
    )
    w = so_far(ordered())
    bars = daily.withColumn("close", F.round(100 * F.product(1 + F.col("x")).over(w), 6))
    return bars.select(
        "series_id",
        "date",
        "close",
        F.round(F.col("close") * (1 + F.col("t") / 4), 6).alias("high"),
        F.round(F.col("close") * (1 - F.col("t") / 4), 6).alias("low"),
        F.col("q").cast("bigint").alias("volume"),
    )


def bars6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six series by return flag and line status."""
    rows = table(spark, sf_dir, "lineitem")
    return flow_bars(rows, F.concat("l_returnflag", "l_linestatus"), F.to_date("l_shipdate"))


def panel25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 series by brand, with calendar gaps."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return flow_bars(rows, F.col("p_brand"), F.to_date("l_shipdate"))


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes by event type."""
    hourly = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("date")
    )
    hourly = hourly.agg(F.round(F.avg("value"), 4).alias("v"), F.count("*").alias("volume"))
    return hourly.select("series_id", "date", F.col("v").alias("close"), "volume")
