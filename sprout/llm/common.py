"""Helpers shared by the operators: stored tables, Arrow text chunks, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared checkpoint folder; return it reread, and its path.

    Cuts lineage like a checkpoint, survives lost executors, and later reads
    prune columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame, key: str) -> DataFrame:
    """Rows of an aggregate dealt by a second hash of ``key``.

    A join on ``key`` then shuffles both its sides, so that adaptive execution
    can split a hot key's partition; straight from the aggregate it can't.
    """
    return df.repartition(F.xxhash64(key, F.lit("apart")))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets (length rows + 1) of an Arrow string column without nulls."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary column over one contiguous buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(data))])


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest linked index of each of 0..n-1, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jump := root[root], root):
            root = jump
    return root


def components(edges: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """Connected components of ``edges`` (u, v: bigint): (node, component = smallest node).

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each round is two grouped minima and two joins, the edge table is written to
    the shared folder after each round, and the number of rounds grows with the
    logarithm of the longest path. Nodes without a link don't appear. Also
    returns the paths that hold the result, for ``discard``.
    """
    spark = edges.sparkSession
    pairs = edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    now, path = store(pairs, name)
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(apart(least, "u"), "u").selectExpr("v AS u", "m AS v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(apart(lowest, "u"), "u")
                 .select(F.explode(F.expr("CASE WHEN v = m THEN array(struct(u, m AS v)) "
                                          "ELSE array(struct(u, m AS v), struct(v AS u, m AS v)) END")).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        after, done = store(small, name)
        # A forest of stars no longer changes: nobody has two smaller ends, no centre has a smaller one.
        tangled = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = after.select("u").join(after.selectExpr("v AS u"), "u", "left_semi").limit(1)
        over = tangled.select("u").unionByName(chained).isEmpty()
        discard(spark, path)
        now, path = after, done
        if over:
            break
    node = now.selectExpr("u AS node", "v AS component")
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return node.unionByName(tops), [path]
