"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dmean(x, scale: int = 4) -> Column:
    """Mean of a column holding values with at most ``scale`` decimals, summed exactly.

    The sum is a decimal (order-independent) and the single division happens in
    double, so every engine and every partitioning yields the same bits.
    """
    c = _c(x)
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double") / F.count(c).cast("double")


def last_rows(daily: DataFrame, n: int, keys: Sequence[str] = ("site_id",), offset: int = 0,
              order: str = "date") -> DataFrame:
    """Rows ``offset+1 .. offset+n`` counted back from the latest ``order`` per key.

    ``row_number() <= k`` is planned as a WindowGroupLimit, so only the top rows of
    each key are shuffled and sorted.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    rn = F.row_number().over(w)
    out = daily.withColumn("_rn", rn).where(F.col("_rn") <= offset + n)
    if offset:
        out = out.where(F.col("_rn") > offset)
    return out.drop("_rn")


def one_row_cross(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (broadcast nested loop, bounded)."""
    return left.crossJoin(F.broadcast(one_row))


def pct_text(x) -> Column:
    """``f"{x:.0%}"`` built from integers: rint(100·x) then '%'."""
    return F.concat(F.rint(_c(x) * 100).cast("bigint").cast("string"), F.lit("%"))


def int_text(x) -> Column:
    return F.rint(_c(x)).cast("bigint").cast("string")


def thousands_text(x) -> Column:
    """``f"{x:,.0f}"`` built from the integer part: 1234567 -> '1,234,567'."""
    digits = F.abs(F.rint(_c(x)).cast("bigint")).cast("string")
    grouped = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(digits), r"(\d{3})(?=\d)", "$1,")), r"^,", "")
    return F.concat(F.when(F.rint(_c(x)) < 0, F.lit("-")).otherwise(F.lit("")), grouped)


def records_json(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Record export: one JSON object per row (dates as text), column ``record``."""
    cols = [F.date_format(c, date_format).alias(c) if t in ("date", "timestamp", "timestamp_ntz") else F.col(c)
            for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("record"))


def history_and_forecast(daily: DataFrame, forecast: DataFrame, days: int = 60,
                         keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Last ``days`` actual days then the forecast, tagged ``kind`` (UNION ALL)."""
    hist = last_rows(daily, days, keys).select(*keys, "date", F.col("visitors").cast("bigint").alias("visitors"),
                                               F.lit("actual").alias("kind"))
    fc = forecast.select(*keys, "date", F.col("predicted_visitors").cast("bigint").alias("visitors"),
                         F.lit("forecast").alias("kind"))
    return hist.unionByName(fc)


def run_concurrently(tasks, max_workers: int = 4) -> list:
    """Run independent Spark jobs from a driver thread pool; results in task order.

    Each task is a zero-argument callable (a model fit, say). Spark schedules the
    jobs of all threads on the same executors, so small fits overlap instead of
    queueing behind each other's per-job latency.
    """
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]
