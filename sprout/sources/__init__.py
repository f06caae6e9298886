"""Readers for the four logical tables, a source registry and a sync summary.

A source is a function ``(spark, location) -> {name: DataFrame}`` returning the
four logical tables. ``parquet`` and ``csv`` read a folder holding
``daily_metrics``, ``seo_pages``, ``users`` and ``keywords`` with explicit
schemas (no inference pass); ``testdata`` derives them from the TPC-H-style
tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, store
from . import testdata
from .schemas import SCHEMAS, require_columns  # noqa: F401

TABLE_NAMES = ["daily_metrics", "seo_pages", "users", "keywords"]


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Project to the logical schema; extra columns (``candidate_id``) are kept."""
    schema = SCHEMAS[name]
    if name == "daily_metrics" and "site_id" not in df.columns:
        df = df.withColumn("site_id", F.lit("all"))
    require_columns(df, [f.name for f in schema.fields], name)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [c for c in df.columns if c not in set(schema.fieldNames())]
    return df.select(*cols, *extra)


def _existing(spark: SparkSession, location: str, extension: str = "") -> dict[str, str]:
    """Paths of the four tables in a folder of any store; a missing one is an error."""
    paths = {n: os.path.join(location, n + extension) for n in TABLE_NAMES}
    if missing := [p for p in paths.values() if not path_exists(spark, p)]:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    return paths


def read_parquet_tables(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    return {n: _typed(spark.read.parquet(p), n) for n, p in _existing(spark, location).items()}


def read_csv_tables(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    out = {}
    for n, path in _existing(spark, location, ".csv").items():
        schema = SCHEMAS[n]
        if n == "daily_metrics":
            # the reference's CSV has no site column
            head = spark.read.option("header", True).csv(path).columns
            if "site_id" not in head:
                from pyspark.sql import types as T
                schema = T.StructType([f for f in schema.fields if f.name != "site_id"])
        out[n] = _typed(spark.read.schema(schema).option("header", True).csv(path), n)
    return out


def read_testdata_tables(spark: SparkSession, location: str, by_site: bool = False) -> dict[str, DataFrame]:
    return {
        "daily_metrics": testdata.daily_metrics(spark, location, by_site=by_site),
        "seo_pages": testdata.seo_pages(spark, location),
        "users": testdata.users(spark, location),
        "keywords": testdata.keywords(spark, location),
    }


def materialize_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Derive each logical table once and keep it as Parquet in the shared folder.

    Training and analysis read the same tables many times (features, several fits,
    scoring, rules); without this every read re-runs the derivation from the raw
    tables (for ``daily_metrics`` a full lineitem aggregate).
    """
    from ..operators.common import run_concurrently
    names = list(tables)
    # independent jobs: overlap them on the cluster instead of queueing one after another
    done = run_concurrently([lambda n=n, d=tables[n]: store(d, n) for n in names], max_workers=len(names))
    return dict(zip(names, done))


SOURCES: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "csv": read_csv_tables,
    "parquet": read_parquet_tables,
    "testdata": read_testdata_tables,
}


def available_sources() -> list[str]:
    return sorted(SOURCES)


def is_available(spark: SparkSession, name: str, location: str) -> bool:
    """Whether a source is there; one that lacks its keywords is, and reading it is an error."""
    if name not in SOURCES:
        return False
    if name == "testdata":
        return path_exists(spark, os.path.join(location, "lineitem.parquet"))
    extension = ".csv" if name == "csv" else ""
    return all(path_exists(spark, os.path.join(location, n + extension)) for n in TABLE_NAMES[:3])


def get_source(name: str) -> Callable[..., dict[str, DataFrame]]:
    try:
        return SOURCES[name]
    except KeyError:
        raise ValueError(f"Unknown source '{name}'. Available: {', '.join(available_sources())}") from None


def load_tables(spark: SparkSession, source: str, location: str, fallback: str | None = "testdata",
                fallback_location: str | None = None, **kw) -> dict[str, DataFrame]:
    """Read the logical tables; an unavailable source falls back to ``fallback``."""
    get_source(source)
    if not is_available(spark, source, location) and fallback:
        source, location = fallback, fallback_location or location
    return get_source(source)(spark, location, **kw)


def write_tables(tables: dict[str, DataFrame], location: str, fmt: str = "parquet") -> None:
    """Table sinks: overwrite one folder per logical table."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(os.path.join(location, f"{name}.csv"))
        else:
            w.parquet(os.path.join(location, name))


def sync_summary(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """One-row summary: source, row counts and the date range of the daily table."""
    d = tables["daily_metrics"].agg(F.count(F.lit(1)).alias("daily_rows"),
                                    F.date_format(F.min("date"), "yyyy-MM-dd").alias("date_min"),
                                    F.date_format(F.max("date"), "yyyy-MM-dd").alias("date_max"))
    p = tables["seo_pages"].agg(F.count(F.lit(1)).alias("pages_rows"))
    u = tables["users"].agg(F.count(F.lit(1)).alias("users_rows"))
    k = tables["keywords"].agg(F.count(F.lit(1)).alias("keywords_rows"))
    # one-row sides only: the cross product is a single row
    return (d.crossJoin(p).crossJoin(u).crossJoin(k)
            .select(F.lit(source).alias("source"), "daily_rows", "pages_rows", "users_rows",
                    "keywords_rows", "date_min", "date_max"))
