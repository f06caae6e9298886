"""Traffic feature matrix, chronological / rolling-origin splits and key-hash splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import h16, md5_key, weekday0
from ..sources.schemas import TRAFFIC_LAGS
from .ordering import ordered_row_number


def traffic_features(daily: DataFrame, keys: Sequence[str] = ("site_id",), target: str = "visitors",
                     drop_incomplete: bool = True) -> DataFrame:
    """Lags 1,2,3,7,14; trailing 7-day mean and sample std excluding today; 7-day
    momentum; Monday=0 weekday and month; ``_delta`` = target - lag_1.

    Rolling values are NULL until the frame holds 7 rows (pandas ``rolling(7)``),
    and incomplete rows are dropped like ``dropna()``. Windows are partitioned by
    series: a series is days x one site, so each partition is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    w7 = w.rowsBetween(-7, -1)
    y = F.col(target).cast("double")
    full7 = F.count(y).over(w7) == 7
    cols = {f"lag_{k}": F.lag(y, k).over(w) for k in TRAFFIC_LAGS}
    cols.update({
        "roll_mean_7": F.when(full7, F.avg(y).over(w7)),
        "roll_std_7": F.when(full7, F.stddev_samp(y).over(w7)),
        "momentum_7": F.lag(y, 1).over(w) - F.lag(y, 8).over(w),
        "dow": weekday0("date"),
        "month": F.month("date"),
        "_delta": y - F.lag(y, 1).over(w),
    })
    out = daily.withColumns(cols)
    return out.dropna() if drop_incomplete else out


def chronological_split(df: DataFrame, eval_fraction: float = 0.15, keys: Sequence[str] = ("site_id",),
                        order: str = "date") -> DataFrame:
    """``split`` = train for the first ``int(n * (1 - f))`` rows of each series, else test."""
    keep = 1.0 - eval_fraction
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = (n * F.lit(keep)).cast("bigint")
    return df.withColumn("split", F.when(F.row_number().over(w) <= cut, "train").otherwise("test"))


def rolling_folds(daily: DataFrame, horizon: int = 14, folds: int = 3, min_train: int = 180,
                  keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Fold table ``(keys, fold, cut, n)``: train rows ``[0, cut)``, test ``[cut, cut+horizon)``.

    ``cut = n - horizon * (folds - i)``; folds with ``cut < min_train`` are skipped.
    The table has folds x series rows.
    """
    n = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    f = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    f = f.withColumn("cut", F.col("n") - F.lit(horizon) * (F.lit(folds) - F.col("fold")))
    return f.where(F.col("cut") >= min_train).where(F.col("cut") < F.col("n"))


def indexed(daily: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """0-based position of each day within its series."""
    w = Window.partitionBy(*keys).orderBy("date")
    return daily.withColumn("idx", F.row_number().over(w) - 1)


def hash_split(df: DataFrame, keys, test_size: float = 0.2, salt: str = "split") -> DataFrame:
    """Unstratified split by a hash of the key columns: no shuffle, reproducible in SQL."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    threshold = int(round(test_size * 65536))
    return df.withColumn("split", F.when(h16(salt, *keys) < threshold, "test").otherwise("train"))


def stratified_split(df: DataFrame, label, key: str, test_size: float = 0.25, salt: str = "strat") -> DataFrame:
    """Exact per-stratum split: within each label value, the first
    ``int(n_label * test_size)`` rows in md5 order of the key are test."""
    lab = F.col(label) if isinstance(label, str) else label
    x = df.withColumn("_stratum", lab).withColumn("_hk", md5_key(salt, key))
    x = ordered_row_number(x, ["_hk", key], keys=["_stratum"], out="_rk")
    sizes = x.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_ns"))
    x = x.join(F.broadcast(sizes), "_stratum")  # one row per stratum
    cut = (F.col("_ns") * F.lit(float(test_size))).cast("bigint")
    return (x.withColumn("split", F.when(F.col("_rk") <= cut, "test").otherwise("train"))
            .drop("_stratum", "_hk", "_rk", "_ns"))


def group_split(df: DataFrame, group: str, test_fraction: float = 0.2, salt: str = "group") -> DataFrame:
    """Split by group: distinct ids in md5 order, the first ``max(1, int(n * f))`` are test."""
    ids = df.select(group).distinct().withColumn("_hk", md5_key(salt, group))
    ids = ordered_row_number(ids, ["_hk", group], out="_rk")
    n = ids.agg(F.count(F.lit(1)).alias("_n"))
    ids = ids.crossJoin(F.broadcast(n))
    n_test = F.greatest(F.lit(1), (F.col("_n") * F.lit(float(test_fraction))).cast("bigint"))
    ids = ids.select(group, F.when(F.col("_rk") <= n_test, "test").otherwise("train").alias("split"))
    return df.join(ids, group)
