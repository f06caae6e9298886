"""Adapter: derive the four logical tables from the TPC-H-style test tables.

* ``daily_metrics``  lineitem by ship day (optionally per supplier region = site)
* ``seo_pages``      the raw-HTML ``pages`` table, parsed with regexes
* ``users``          orders + lineitem per customer, features before a cutoff
* ``keywords``       lineitem by (part, supplier): every supplier of a part is a candidate

Every aggregate is a plain Spark aggregate (partial + final, so a hot key is
combined map-side), money and quantities are summed as decimals so the result
does not depend on row order, and surrogate columns are md5 hashes of the key.
The same derivations are written as DuckDB SQL in ``sprout.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import h16, md5_key, rnd
from ..operators.ordering import rank_within
from ..session import store

DEC = "decimal(18,2)"
# Narrow input decimals keep sums within 18 digits, where Spark aggregates on a
# long instead of BigDecimal (several times faster) and stays exact.
QTY, RATE, MONEY = "decimal(8,2)", "decimal(4,2)", "decimal(12,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _dsum(c, t: str = DEC) -> F.Column:
    return F.sum(F.col(c).cast(t) if isinstance(c, str) else c.cast(t))


# ---------------------------------------------------------------------------
# daily_metrics
# ---------------------------------------------------------------------------
def daily_metrics(spark: SparkSession, sf_dir: str, by_site: bool = False) -> DataFrame:
    """One row per (site_id, date); calendar densified per site.

    With ``by_site`` the site is the supplier's region name (nation and region are
    fixed 25- and 5-row tables, so broadcasting them is bounded; supplier itself
    grows with the data and is left to the planner / AQE).
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    if by_site:
        sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
        nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
        reg = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
        site_of = (sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
                   .join(F.broadcast(reg), F.col("n_regionkey") == reg.r_regionkey)
                   .select(F.col("s_suppkey"), F.col("r_name").alias("site_id")))
        li = li.join(site_of, li.l_suppkey == site_of.s_suppkey)
    else:
        li = li.withColumn("site_id", F.lit("all"))

    is_r = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast(QTY)
    zero = F.lit(0).cast(QTY)
    aggs = [_dsum("l_quantity", QTY).alias("qty"),
            F.sum(F.when(~is_r, qty).otherwise(zero)).alias("organic"),
            F.sum(F.when(is_r, qty).otherwise(zero)).alias("paid"),
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(is_r).alias("n_r"),
            F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
            _dsum("l_discount", RATE).alias("disc"),
            _dsum("l_tax", RATE).alias("tax"),
            F.sum(F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(RATE))).alias("rev")]
    day_key = [F.col("site_id"), F.to_date("l_shipdate").alias("date")]
    # sums per (site, day) combine map-side into a tiny shuffle; the distinct order
    # count runs alone (planned without Expand: only de-duplicated (site, day, order)
    # keys, three narrow columns, are shuffled); the two day-grain results are joined.
    # A two-level (site, day, order) -> (site, day) aggregate would shuffle nearly
    # every line with all nine aggregate buffers (an order's lines ship on different days).
    sums = li.groupBy(*day_key).agg(*aggs)
    orders = li.groupBy(*day_key).agg(F.countDistinct("l_orderkey").alias("n_orders"))
    day = sums.join(orders, ["site_id", "date"])

    n = F.col("n_lines").cast("double")
    visitors = F.col("qty").cast("bigint")
    sessions = visitors + F.col("n_lines")
    day = day.select(
        "site_id", "date",
        visitors.alias("visitors"),
        sessions.alias("sessions"),
        F.col("organic").cast("bigint").alias("organic_traffic"),
        F.col("paid").cast("bigint").alias("paid_traffic"),
        rnd(F.lit(0.5) + F.lit(0.3) * (F.col("n_r") / n), 4).alias("bounce_rate"),
        rnd(F.lit(60.0) + F.lit(4.0) * (F.col("qty").cast("double") / n), 1).alias("avg_time_on_site"),
        rnd(F.col("disc").cast("double") / n, 4).alias("ctr"),
        rnd(F.lit(1.0) + F.lit(200.0) * (F.col("tax").cast("double") / n), 2).alias("avg_position"),
        F.col("n_lines"),
        rnd(F.lit(40.0) + F.lit(60.0) * (F.col("n_f") / n), 1).alias("page_speed"),
        rnd(F.lit(100.0) * (F.col("qty").cast("double") / n) / F.lit(50.0), 1).alias("content_score"),
        rnd(F.col("n_orders") / sessions.cast("double"), 4).alias("conversion_rate"),
        F.col("n_orders").alias("sales"),
        rnd(F.col("rev").cast("double"), 2).alias("revenue"),
    )
    return densify_daily(day)


def densify_daily(day: DataFrame) -> DataFrame:
    """Fill missing days per site in one pass: counts 0, rates carried forward; add backlinks.

    Each present day expands to itself plus the missing days up to the next present
    day (``lead`` over the site's days), taking its own rates; no calendar join and
    no second scan. Both windows share the site partitioning, so one shuffle of
    day-grain rows serves them.
    """
    w = Window.partitionBy("site_id").orderBy("date")
    x = day.withColumn("_until", F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")))
    x = x.withColumn("_d", F.explode(F.sequence(F.col("date"), F.col("_until")))).drop("_until")
    gap = F.col("_d") != F.col("date")
    counts = ["visitors", "sessions", "organic_traffic", "paid_traffic", "n_lines", "sales"]
    cols = {c: F.when(gap, F.lit(0)).otherwise(F.col(c)).cast("bigint") for c in counts}
    cols["revenue"] = F.when(gap, F.lit(0.0)).otherwise(F.col("revenue"))
    x = x.withColumns(cols).withColumn("date", F.col("_d")).drop("_d")
    w_run = Window.partitionBy("site_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("backlinks", (F.sum("n_lines").over(w_run) + 500).cast("bigint"))
    return x.select("site_id", "date", "visitors", "sessions", "organic_traffic", "paid_traffic",
                    "bounce_rate", "avg_time_on_site", "ctr", "avg_position", "backlinks",
                    "page_speed", "content_score", "conversion_rate", "sales", "revenue")


# ---------------------------------------------------------------------------
# seo_pages
# ---------------------------------------------------------------------------
WORD_RE = r"[^ \t\n\r\f]+"
#: What isn't page text: scripts, styles and comments with their bodies, then tags.
HIDDEN_RE = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG_RE = r"<[^>]+>"
#: Entities decoded in page text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "\u00a9"),
            ("&middot;", "\u00b7"), ("&amp;", "&"))


def decoded(text: F.Column) -> F.Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def seo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-URL page facts parsed from raw HTML.

    Facts that the table has no field for follow from the markup: a page is the
    slower the longer it is, and its traffic stands in words times internal links.
    """
    pg = read_table(spark, sf_dir, "pages", ["url", "html"])
    count = lambda pattern: F.regexp_count("html", F.lit(pattern))
    text = decoded(F.regexp_replace(F.regexp_replace("html", HIDDEN_RE, " "), TAG_RE, " "))
    images = count("<img[ >]")
    base = pg.select(
        "url",
        F.regexp_count(text, F.lit(WORD_RE)).cast("bigint").alias("word_count"),
        images.cast("bigint").alias("images"),
        F.when(images == 0, 1.0).otherwise(rnd(count('<img[^>]* alt="[^"]').cast("double")
                                               / F.greatest(images, F.lit(1)).cast("double"), 3)).alias("alt_ratio"),
        count('<a href="/').cast("bigint").alias("internal_links"),
        count('<a href="http').cast("bigint").alias("external_links"),
        F.length(decoded(F.regexp_extract("html", r"<title>(.*?)</title>", 1))).cast("bigint").alias("title_length"),
        F.length(decoded(F.regexp_extract("html", r'<meta name="description" content="([^"]*)"', 1))).cast("bigint")
        .alias("meta_length"),
        count(r"<h1[ >]").cast("bigint").alias("h1_count"),
        rnd(F.lit(20.0) + F.lit(1600000.0) / (F.lit(20000.0) + F.length("html")), 1).alias("page_speed"),
        F.when(F.col("html").contains("application/ld+json"), 1).otherwise(0).alias("has_schema"),
        F.when(F.col("html").contains('name="viewport"'), 1).otherwise(0).alias("mobile_friendly"),
    )
    # min-max scaling needs two passes; parse the HTML once into a small stored
    # feature table and make both passes over that
    scored = store(base.withColumn("_s", page_points()), "page-facts")
    bounds = scored.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    out = scored.crossJoin(F.broadcast(bounds))  # one-row side: bounded
    seo = rnd(F.lit(100.0) * (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 1)
    return out.select(
        "url", "word_count", "images", "alt_ratio", "internal_links", "external_links",
        "title_length", "meta_length", "h1_count", "page_speed", "has_schema", "mobile_friendly",
        seo.alias("seo_score"), (F.col("word_count") * F.col("internal_links")).alias("organic_traffic"))


def page_points() -> F.Column:
    """The adapter's own page score before scaling: text and links up to a full mark,
    ten points for each of six checks that hold, and a fifth of the speed."""
    full = lambda c, most: F.least(F.col(c).cast("double") / F.lit(most), F.lit(1.0))
    checks = [F.col("title_length").between(30, 60), F.col("meta_length").between(70, 160), F.col("h1_count") == 1,
              F.col("alt_ratio") >= 0.9, F.col("has_schema") == 1, F.col("mobile_friendly") == 1]
    held = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0))
    return (F.lit(50.0) * full("word_count", 1200.0) + F.lit(25.0) * full("internal_links", 8.0)
            + F.lit(10.0) * held.cast("double") + F.col("page_speed") / F.lit(5.0))


# ---------------------------------------------------------------------------
# users
# ---------------------------------------------------------------------------
CUTOFF_DAYS = 180


def padded_id(prefix: str, key: F.Column) -> F.Column:
    """Prefix and key, zero-padded to six digits; longer keys stay whole (``lpad`` would cut them)."""
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with an order on or before the cutoff.

    Lineitem is first reduced to one row per order (partial aggregation), so the
    join with orders is 1:1 on the order key and ships order-grain data only.
    """
    od = read_table(spark, sf_dir, "orders",
                    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                     "o_orderpriority"]).withColumn("od", F.to_date("o_orderdate"))
    cutoff = od.agg(F.date_sub(F.max("od"), CUTOFF_DAYS).alias("cutoff"))
    lines = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"), _dsum("l_quantity", QTY).alias("qty")))
    o = (od.crossJoin(F.broadcast(cutoff))  # one-row side
         .join(lines, od.o_orderkey == lines.l_orderkey, "left"))
    pre = F.col("od") <= F.col("cutoff")
    urgent = pre & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    per = (o.groupBy("o_custkey")
           .agg(F.count_if(pre).alias("sessions"),
                F.sum(F.when(pre, F.coalesce("n_lines", F.lit(0)))).alias("pageviews"),
                F.sum(F.when(pre, F.coalesce("qty", F.lit(0).cast("decimal(18,2)"))))
                .alias("qty"),
                F.max(F.when(pre, F.col("od"))).alias("last_od"),
                F.first("cutoff").alias("cutoff"),
                F.count_if(urgent).alias("num_orders"),
                F.sum(F.when(urgent, F.col("o_totalprice").cast(MONEY))).alias("spent"),
                F.count_if(~pre).alias("n_after"))
           .where(F.col("sessions") > 0))
    pv = F.col("pageviews").cast("double")
    return per.select(
        padded_id("u", F.col("o_custkey")).alias("user_id"),
        F.col("sessions").cast("bigint").alias("sessions"),
        F.col("pageviews").cast("bigint").alias("pageviews"),
        F.when(pv > 0, rnd(F.try_divide(F.lit(6.0) * F.col("qty").cast("double"), pv), 1)).otherwise(0.0)
        .alias("avg_time_on_site"),
        F.datediff("cutoff", "last_od").cast("bigint").alias("recency_days"),
        F.col("num_orders").cast("bigint").alias("num_orders"),
        F.coalesce(F.col("spent").cast("double"), F.lit(0.0)).alias("total_spent"),
        F.when(F.col("n_after") == 0, 1).otherwise(0).alias("churned"),
    )


# ---------------------------------------------------------------------------
# keywords
# ---------------------------------------------------------------------------
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (part, supplier) candidate; a part is a keyword.

    Every supplier of a part competes (no cap on candidates). Lineitem is first
    pre-aggregated to (part, supplier) grain and stored once; part-level values are
    a grouped aggregate joined back, and positions split hot keywords across tasks.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_quantity", "l_discount"])
    # (part, supplier) grain, combined map-side, stored once: both the part-level
    # aggregate and the candidate rows read it, so lineitem is scanned once
    cand = store(li.groupBy("l_partkey", "l_suppkey")
                 .agg(F.count(F.lit(1)).alias("n"), _dsum("l_quantity", QTY).alias("qty"),
                      _dsum("l_discount", RATE).alias("disc"))
                 .withColumn("_ours_key", md5_key("ours", "l_partkey", "l_suppkey")), "keyword-candidates")
    # part-level values as a grouped aggregate (partial + final, so a hot part is
    # combined map-side) joined back on the part key (one row per part)
    per_part = cand.groupBy("l_partkey").agg(F.sum("qty").alias("sv"), F.min("_ours_key").alias("_min_ours"),
                                             F.count(F.lit(1)).alias("_gsize"))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    rel = rnd(F.col("disc").cast("double") / F.col("n").cast("double") * F.lit(10.0), 3)
    kw = (cand.join(per_part, "l_partkey")
          .join(part, F.col("l_partkey") == part.p_partkey)
          .withColumnRenamed("l_partkey", "keyword_id")
          .select(
              "keyword_id",
              F.col("p_name").alias("keyword"),
              F.col("sv").cast("bigint").alias("search_volume"),
              (F.col("p_size") * 2).cast("double").alias("keyword_difficulty"),
              F.when(F.col("_ours_key") == F.col("_min_ours"), 1).otherwise(0).alias("is_ours"),
              rel.alias("relevance"),
              (F.col("qty") * 20).cast("bigint").alias("word_count"),
              (F.col("n") * 10).cast("bigint").alias("backlinks"),
              (F.lit(1.0) + (h16("da", "l_suppkey") % 100)).alias("domain_authority"),
              (F.lit(20.0) + (h16("ps", "l_suppkey") % 801) / F.lit(10.0)).alias("page_speed"),
              F.when(rel > 0.4, 1).otherwise(0).alias("keyword_in_title"),
              F.when(rel > 0.5, 1).otherwise(0).alias("keyword_in_h1"),
              (h16("il", "keyword_id", "l_suppkey") % 20).cast("bigint").alias("internal_links"),
              F.col("l_suppkey").alias("candidate_id"), F.col("qty").alias("_units"), "_gsize",
          ))
    # the adapter's own order: the supplier that sold most of a part stands first
    kw = rank_within(kw, ["keyword_id"], [F.desc("_units"), F.col("candidate_id")], out="position")
    kw = kw.withColumn("position", F.col("position").cast("int"))
    return kw.withColumn("relevance_label", relevance_label("position", "_gsize")).drop("_units", "_gsize")


def relevance_label(position: str, size: str) -> F.Column:
    """Label 4 to 0 by fifths of the group: the best fifth is 4."""
    return (F.lit(4) - F.floor(F.lit(5) * (F.col(position) - 1) / F.col(size))).cast("int")
