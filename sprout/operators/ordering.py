"""Exact row numbers over a global or grouped order without one hot task.

``row_number() OVER (ORDER BY ...)`` with no partition key, or with a key that
holds a third of the rows, runs in a single task. Here the rows are
range-partitioned on (keys, order) instead, sorted and stamped with their place,
stored once (so a retried or re-planned pass can't see another range split),
numbered inside (partition, key), and shifted by the key's rows in earlier
partitions. A key that goes on from an earlier partition is the first one of its
partition, so the table of shifts has at most one row per partition: that bounds
its broadcast whatever the keys.

The order must be total (end it with a unique column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

_POS_MASK = (1 << 33) - 1
GROUP_ROWS = 1_000_000  # rows of a group that one task numbers


def ordered_row_number(df: DataFrame, order: Sequence, keys: Sequence[str] = (), out: str = "rn",
                       partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` with every group split over range partitions."""
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, order = list(keys), list(order)
    s = store(df.repartitionByRange(n_parts, *keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn("_mid", F.monotonically_increasing_id()), "ordered-rows")
    s = (s.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
         .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_POS_MASK))))
    blocks = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"))
    before = F.sum("_cnt").over(Window.partitionBy(*keys).orderBy("_pid")) - F.col("_cnt")
    shifts = (blocks.withColumn("_off", before).where(F.col("_off") > 0)
              .select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_off"))
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy("_pos")) if keys else F.col("_pos") + 1
    return (s.withColumn(out, place).join(F.broadcast(shifts), on, "left")  # at most one row per partition
            .withColumn(out, (F.col(out) + F.coalesce("_off", F.lit(0))).cast("bigint"))
            .select(*df.columns, out))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` that no hot group holds up.

    Groups of up to ``GROUP_ROWS`` rows are numbered by a plain window, without a stored
    table; only larger ones are split over range partitions.
    """
    keys = list(keys)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > GROUP_ROWS)
    hot = sizes.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).collect()  # at most rows / GROUP_ROWS
    if not hot:
        return df.withColumn(out, plain)
    known = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).schema))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    split = ordered_row_number(df.join(known, same, "left_semi"), order, keys, out)
    return df.join(known, same, "left_anti").withColumn(out, plain).select(*df.columns, out).unionByName(split)
