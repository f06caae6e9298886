"""Skew-safe ranking equals the plain window, with and without hot groups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sprout.operators.ordering import ordered_row_number, rank_within


def _frame(spark):
    rows = [("hot", i % 7, i) for i in range(300)] + [(f"k{j}", j % 3, 1000 + j) for j in range(40)]
    return spark.createDataFrame(rows, "k string, v int, id int")


def _expected(df):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    return {(r["k"], r["id"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}


def test_rank_within_splits_hot_groups(spark):
    df = _frame(spark)
    got = rank_within(df, ["k"], [F.desc("v"), F.col("id")], out="rn")
    assert {(r["k"], r["id"]): r["rn"] for r in got.collect()} == _expected(df)


def test_a_group_spans_many_partitions_and_null_is_a_group(spark):
    df = _frame(spark).unionByName(spark.createDataFrame([(None, i % 3, 5000 + i) for i in range(60)], "k string, v int, id int"))
    got = ordered_row_number(df, [F.desc("v"), F.col("id")], keys=["k"], partitions=16)
    assert {(r["k"], r["id"]): r["rn"] for r in got.collect()} == _expected(df)


def test_ordered_row_number_global(spark):
    df = _frame(spark)
    got = ordered_row_number(df, ["v", "id"], out="rn", partitions=5).collect()
    ranks = sorted(((r["v"], r["id"]), r["rn"]) for r in got)
    assert [r for _, r in ranks] == list(range(1, len(ranks) + 1))


def test_only_groups_over_the_limit_are_split_and_stored(spark, monkeypatch):
    from sprout.operators import ordering
    null = spark.createDataFrame([(None, i % 3, 5000 + i) for i in range(60)], "k string, v int, id int")
    stored, store = [], ordering.store
    monkeypatch.setattr(ordering, "store", lambda df, name: stored.append(df.count()) or store(df, name))
    for rows, split in ((1_000, []), (100, [300]), (30, [360])):
        monkeypatch.setattr(ordering, "GROUP_ROWS", rows, raising=False)
        df, _ = _frame(spark).unionByName(null), stored.clear()
        got = rank_within(df, ["k"], [F.desc("v"), F.col("id")])
        assert got.columns == [*df.columns, "rn"] and dict(got.dtypes)["rn"] == "bigint"
        assert {(r["k"], r["id"]): r["rn"] for r in got.collect()} == _expected(df) and stored == split
