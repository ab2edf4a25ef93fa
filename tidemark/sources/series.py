"""Where series come from and go to: tables to bars, ticks, pairs and vectors; any Spark format in and out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, stream: bool = False, **options: Any) -> DataFrame:
    """Series from files (parquet, orc, csv, json, text) or any other source Spark knows (jdbc, kafka, rate), as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).format(kind).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = (), **options: Any) -> None:
    """A table of results, in folders by the ``by`` columns."""
    df.write.format(kind).mode(mode).options(**options).partitionBy(*by).save(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("series").orderBy(*order)).cast("long"))


def bars(events: DataFrame, infinite: bool = False) -> DataFrame:
    """Hourly bars of every event type: series, seq, hour, open, high, low, close, volume, ret (0 on the first). Empty hours have none.

    After a close of zero ret is 0, for kernels take finite numbers only; with ``infinite`` it is what floating point makes of the ratio: infinite, or NaN where both closes are zero.
    """
    at = F.struct("ts", "event_id")
    hourly = events.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    before = F.lag("close").over(Window.partitionBy("series").orderBy("hour"))
    ratio = F.try_divide("close", before)
    if infinite:  # F.pow knows no error of division
        ratio = F.when(before == 0, F.col("close") * F.pow(before, F.lit(-1.0))).otherwise(ratio)
    return numbered(hourly, ["hour"]).withColumn("ret", F.coalesce(ratio - 1.0, F.lit(0.0)))


def ticks(events: DataFrame) -> DataFrame:
    """Every event's value: series (event type), seq, x, and y, the value three ticks before (the first three: x)."""
    rows = numbered(events.select(F.col("event_type").alias("series"), "ts", "event_id", F.col("value").alias("x")), ["ts", "event_id"])
    return rows.withColumn("y", F.coalesce(F.lag("x", 3).over(Window.partitionBy("series").orderBy("seq")), F.col("x"))).select("series", "seq", "x", "y")


def pairs(orders: DataFrame) -> DataFrame:
    """Daily returns of each order priority's mean price against the market's: series, seq, asset, market, smb, hml, mom, rmw, cma, rf.

    The factors beside the market are lags of its return, so that they are defined on every row.
    """
    daily = orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("p"))
    market = orders.groupBy(F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("m"))
    w = Window.partitionBy("series").orderBy("day")
    rows = daily.join(market, "day").withColumns({"asset": F.try_divide("p", F.lag("p").over(w)) - 1.0, "market": F.try_divide("m", F.lag("m").over(w)) - 1.0})
    rows = numbered(rows.filter("asset is not null"), ["day"])
    later = Window.partitionBy("series").orderBy("seq")
    lags = {n: F.coalesce(F.lag("market", k).over(later), F.lit(0.0)) for k, n in enumerate(("smb", "hml", "mom", "rmw", "cma"), 1)}
    return rows.withColumns(lags | {"rf": F.lit(0.001)}).select("series", "seq", "asset", "market", *lags, "rf")


def vectors(events: DataFrame) -> DataFrame:
    """Hourly returns of all event types as arrays, hours without a bar of a type counting 0: series ('all'), seq, returns, weights."""
    every = bars(events).groupBy("hour").agg(F.map_from_entries(F.collect_list(F.struct("series", "ret"))).alias("by"))
    # The event types of the test tables.
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = every.select(F.lit("all").alias("series"), "hour", F.array(*[F.coalesce(F.try_element_at("by", F.lit(k)), F.lit(0.0)) for k in kinds]).alias("returns"))
    return numbered(rows, ["hour"]).withColumn("weights", F.array(*[F.lit((k + 1) / 15.0) for k in range(5)])).select("series", "seq", "returns", "weights")


def options(events: DataFrame) -> DataFrame:
    """An option chain from events: spot 100, strikes and terms from the value: series, seq, price, spot, strike, ttm, rate, sigma, is_call, curve, terms."""
    rows = ticks(events).withColumns(
        {
            "spot": F.lit(100.0),
            "strike": 60.0 + F.least(F.col("x"), F.lit(80.0)),
            "ttm": 0.1 + F.pmod("seq", F.lit(20)) / 10.0,
            "rate": F.lit(0.03),
            "sigma": 0.1 + F.pmod("seq", F.lit(7)) / 20.0,
            "is_call": F.pmod("seq", F.lit(2)) == 0,
            "curve": F.array(*[20.0 + F.col("x") / (100.0 * k) for k in (1, 2, 3)]),
            "terms": F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)),
        }
    )
    return rows.drop("y")
