"""Line dedup by distinct-site spread.

Lines are normalised (white space collapsed, lower case) and hashed. A line that
occurs fewer times than the threshold can't be on that many sites, so those drop
out after a count. For the others a HyperLogLog sketch of the sites per line hash
is merged by aggregation, straight from the lines; lines whose estimate is near the
threshold get an exact distinct count, the others are decided by the estimate. Lines
on at least ``min_sites`` sites are boilerplate and are removed from every document.

Boilerplate frames a document; it isn't the document. A text in which every visible
line is boilerplate is a copy of others and stays whole: it belongs to the
near-duplicate operators, and no document is emptied. From all others the lines go,
however little is left.

Null texts stay null, empty texts empty, texts of any length are read whole. Lines
without a visible character are never removed. A null site is no site. Rows that repeat
a doc_id give a row each. Other columns pass through unchanged, whatever their names
(``n_chars`` follows the text where the table has it; own ``n_lines`` and ``n_removed``
columns give way to the report's). An empty table gives an empty result. Rows without
an id share one set of found lines; as found lines go from every text, that changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, store

MIN_SITES = 10
SKETCH_BITS, MARGIN = 10, 0.25


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Hash of the normalised line; null if nothing visible is left."""
    plain = F.trim(F.lower(F.regexp_replace(line, "[ \t\r\f\x0b]+", " ")))
    return F.when(plain != "", F.xxhash64(plain))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(line_key) of lines on at least ``min_sites`` sites, and the stored (doc_id, site, line_key) table."""
    keys = F.array_compact(F.array_distinct(F.transform(split_lines(F.col(text_col)), line_key)))
    lines, _ = store(docs.select(F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"),
                                 F.explode(keys).alias("line_key")), "line-keys")
    often = (lines.where("site IS NOT NULL").groupBy("line_key").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_sites).select("line_key"))
    often, _ = store(often, "line-often")
    sited = lines.where("site IS NOT NULL").join(apart(often, "line_key"), "line_key", "left_semi")
    spread = (sited.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
              .select("line_key", F.hll_sketch_estimate("sketch").alias("sites")))
    spread, _ = store(spread, "line-spread")
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    sure = spread.where(F.col("sites") > high).select("line_key")
    near = spread.where(F.col("sites").between(low, high)).select("line_key")
    exact = (sited.join(near, "line_key", "left_semi").select("line_key", "site").distinct()
             .groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line_key"))
    return sure.unionByName(exact), lines


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", report: bool = True) -> DataFrame:
    """All columns of ``docs`` with the text cleaned; ``report`` adds n_lines and n_removed."""
    bad, lines = boilerplate(docs, min_sites, id_col, text_col, site_col)
    bad, _ = store(bad, "line-boilerplate")
    hit = lines.join(bad, "line_key").groupBy("doc_id").agg(F.collect_set("line_key").alias("bad")).withColumnRenamed("doc_id", "id")
    # the table's own columns travel as one, so no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(apart(hit, "id"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")), "left")
    text = F.col(f"row.`{text_col}`")  # not a column of its own, which would be shuffled as well
    is_bad = lambda x: F.coalesce(F.array_contains("bad", line_key(x)), F.lit(False))
    out = joined.withColumn("every", split_lines(text)).withColumn(
        "stay", F.when(F.col("bad").isNull(), F.col("every")).otherwise(F.filter("every", lambda x: ~is_bad(x))))
    whole = F.col("bad").isNull() | ~F.exists("stay", lambda x: line_key(x).isNotNull())  # no line of its own
    cleaned = F.when(text.isNull() | whole, text).otherwise(F.array_join("stay", "\n"))
    removed = F.when(text.isNull() | whole, F.lit(0)).otherwise(F.size("every") - F.size("stay"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size("every"))
    columns = [cleaned.alias(c) if c == text_col
               else F.char_length(cleaned).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
               for c in docs.columns if not (report and c in ("n_lines", "n_removed"))]
    return out.select(*columns, *[n_lines.alias("n_lines"), removed.alias("n_removed")] * report)
