"""Readers, registry, sinks and the adapter's invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from sprout import sources as S


def test_registry_and_errors():
    assert S.available_sources() == ["csv", "parquet", "testdata"]
    with pytest.raises(ValueError, match="Unknown source"):
        S.get_source("nope")


def test_write_and_read_back(spark, scratch):
    t = S.read_testdata_tables(spark, SMOKE)
    S.write_tables(t, scratch, "parquet")
    S.write_tables(t, scratch, "csv")
    for fmt in ("parquet", "csv"):
        back = S.get_source(fmt)(spark, scratch)
        assert back["daily_metrics"].count() == t["daily_metrics"].count()
        assert back["users"].schema["churned"].dataType.simpleString() == "int"
        S.write_tables({k: v for k, v in t.items() if k != "keywords"}, f"{scratch}/part", fmt)
        with pytest.raises(FileNotFoundError, match="keywords"):
            S.load_tables(spark, fmt, f"{scratch}/part", fallback_location=SMOKE)
    fb = S.load_tables(spark, "parquet", "/nonexistent", fallback="testdata", fallback_location=SMOKE)
    assert fb["seo_pages"].count() == t["seo_pages"].count()


def test_adapter_invariants(spark):
    t = S.read_testdata_tables(spark, SMOKE)
    d = t["daily_metrics"]
    assert d.where(F.col("visitors") != F.col("organic_traffic") + F.col("paid_traffic")).count() == 0
    assert d.select("date").distinct().count() == d.count()
    s = t["seo_pages"].agg(F.min("seo_score"), F.max("seo_score")).first()
    assert s[0] == 0.0 and s[1] == 100.0
    k = t["keywords"]
    ours = k.groupBy("keyword_id").agg(F.sum("is_ours").alias("o"), F.count(F.lit(1)).alias("n"),
                                       F.max("position").alias("m"))
    assert ours.where((F.col("o") != 1) | (F.col("m") != F.col("n"))).count() == 0


def test_sync_summary(spark):
    t = S.read_testdata_tables(spark, SMOKE)
    r = S.sync_summary(t, "testdata").first()
    assert r["source"] == "testdata" and r["daily_rows"] > 0 and r["date_min"] <= r["date_max"]


def test_require_columns():
    class Fake:
        columns = ["a"]
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        S.require_columns(Fake(), ["a", "c", "b"], "x")


def test_materialize_tables_keeps_every_row(spark):
    from sprout.sources import materialize_tables, read_testdata_tables
    from conftest import SMOKE
    tables = read_testdata_tables(spark, SMOKE, by_site=True)
    done = materialize_tables(tables)
    assert set(done) == set(tables)
    for name, df in tables.items():
        assert done[name].count() == df.count()
        assert done[name].columns == df.columns


def test_long_customer_keys_stay_distinct(spark):
    from sprout.sources.testdata import padded_id
    keys = [7, 999_999, 1_000_001, 1_000_009, 12_345_678]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(padded_id("u", F.col("k"))).collect()]
    assert got == ["u000007", "u999999", "u1000001", "u1000009", "u12345678"]


def test_sources_read_uris_and_report_missing_tables(spark, scratch):
    from sprout.sources import is_available, load_tables, read_parquet_tables, read_testdata_tables, write_tables
    tables = read_testdata_tables(spark, "file:///root/testdata/sf0.001")
    write_tables(tables, f"file://{scratch}/all")
    again = read_parquet_tables(spark, f"file://{scratch}/all")
    assert sorted(again) == sorted(tables) and again["users"].count() == tables["users"].count()
    write_tables({"users": tables["users"]}, f"file://{scratch}/part")
    assert is_available(spark, "parquet", f"file://{scratch}/all") and not is_available(spark, "parquet", f"file://{scratch}/part")
    with pytest.raises(FileNotFoundError, match="daily_metrics"):
        load_tables(spark, "parquet", f"file://{scratch}/part", fallback=None)
