"""Evaluation metrics as DataFrame -> DataFrame aggregates.

All are one grouped aggregate (partial + final), except AUC (one range-sorted
pass for exact average ranks) and NDCG (per-group ordering of score blocks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ordered_row_number

EPS = 2.220446049250313e-16  # float64 machine epsilon (library MAPE guard)


def regression_metrics(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, masked MAPE (NULL when every actual is 0), epsilon MAPE and R²."""
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    err = a - p
    sse = F.sum(err * err)
    sst = F.var_pop(a) * F.count(a)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(a != 0, F.abs(F.try_divide(err, a)))).alias("mape"),
        F.avg(F.abs(err) / F.greatest(F.abs(a), F.lit(EPS))).alias("mape_eps"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def auc(df: DataFrame, label: str, score: str, tiebreak: str) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney with average ranks for tied scores); NULL with one class.

    Ranks come from ``ordered_row_number``, so no single task sorts the data.
    """
    x = ordered_row_number(df.select(F.col(label).alias("_y"), F.col(score).alias("_s"), tiebreak),
                           ["_s", tiebreak], out="_r")
    ties = x.groupBy("_s").agg(F.min("_r").alias("lo"), F.max("_r").alias("hi"),
                               F.count_if(F.col("_y") == 1).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    t = ties.agg(F.sum(F.col("pos") * (F.col("lo") + F.col("hi")) / F.lit(2.0)).alias("rsum"),
                 F.sum("pos").alias("P"), (F.sum("cnt") - F.sum("pos")).alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    val = F.try_divide(F.col("rsum") - P * (P + F.lit(1.0)) / F.lit(2.0), P * N)
    return t.select(F.when((F.col("P") > 0) & (F.col("N") > 0), val).alias("auc"),
                    F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def ndcg_per_group(df: DataFrame, group: str, label: str, score: str, ks=(10,)) -> DataFrame:
    """NDCG@k per group for every k in ``ks`` (columns ``ndcg_at_{k}``), in one pass.

    Linear gain, log2 discount, tied scores share their gains (averaged over the
    positions they span). Groups under 2 rows are skipped; a group with no
    relevant item scores 0.
    """
    kmax = max(ks)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn")).where(F.col("_gn") >= 2).select(group)
    # rank() <= k keeps whole tie blocks that start before position k; applied to the
    # input directly it plans as a WindowGroupLimit both before and after the shuffle,
    # and a block's start is its rank - 1, so no cumulative window is needed. Groups
    # under 2 rows are dropped afterwards with a semi join on the group sizes.
    wr = Window.partitionBy(group).orderBy(F.desc(score))
    top = (df.withColumn("_rk", F.rank().over(wr)).where(F.col("_rk") <= kmax)
           .join(sizes, group, "left_semi"))
    blocks = top.groupBy(group, F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("nb"), F.sum(F.col(label).cast("double")).alias("gsum"),
        (F.min("_rk") - 1).alias("start"))

    def disc(k):
        return F.aggregate(F.sequence(F.col("start"), F.least(F.col("start") + F.col("nb"), F.lit(k)) - 1),
                           F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / F.log2(p + F.lit(2.0)))
    dcg = blocks.groupBy(group).agg(*[
        F.sum(F.when(F.col("start") < k, F.col("gsum") / F.col("nb") * disc(k))).alias(f"dcg_{k}") for k in ks])
    wi = Window.partitionBy(group).orderBy(F.desc(label))
    gain = F.col(label).cast("double") / F.log2(F.col("_ri") + F.lit(1.0))
    ideal = (df.withColumn("_ri", F.row_number().over(wi)).where(F.col("_ri") <= kmax)
             .join(sizes, group, "left_semi")
             .groupBy(group).agg(*[F.sum(F.when(F.col("_ri") <= k, gain)).alias(f"idcg_{k}") for k in ks]))
    return dcg.join(ideal, group).select(group, *[
        F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0).alias(f"ndcg_at_{k}")
        for k in ks])


def mean_ndcg(df: DataFrame, group: str, label: str, score: str, ks=(10, 5)) -> DataFrame:
    """Mean NDCG over groups for each k: one row with ``ndcg_at_{k}`` and ``n_groups``."""
    per = ndcg_per_group(df, group, label, score, ks)
    return per.agg(*[F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks], F.count(F.lit(1)).alias("n_groups"))
