"""The four logical input tables, their feature lists and the column check."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, I, S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()


def _struct(fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DAILY = _struct([
    ("site_id", S), ("date", T.DateType()),
    ("visitors", L), ("sessions", L), ("organic_traffic", L), ("paid_traffic", L),
    ("bounce_rate", D), ("avg_time_on_site", D), ("ctr", D), ("avg_position", D),
    ("backlinks", L), ("page_speed", D), ("content_score", D), ("conversion_rate", D),
    ("sales", L), ("revenue", D),
])

SEO_PAGES = _struct([
    ("url", S), ("word_count", L), ("images", L), ("alt_ratio", D), ("internal_links", L),
    ("external_links", L), ("title_length", L), ("meta_length", L), ("h1_count", L),
    ("page_speed", D), ("has_schema", I), ("mobile_friendly", I), ("seo_score", D),
    ("organic_traffic", L),
])

USERS = _struct([
    ("user_id", S), ("sessions", L), ("pageviews", L), ("avg_time_on_site", D),
    ("recency_days", L), ("num_orders", L), ("total_spent", D), ("churned", I),
])

KEYWORDS = _struct([
    ("keyword_id", L), ("keyword", S), ("search_volume", L), ("keyword_difficulty", D),
    ("is_ours", I), ("relevance", D), ("word_count", L), ("backlinks", L),
    ("domain_authority", D), ("page_speed", D), ("keyword_in_title", I), ("keyword_in_h1", I),
    ("internal_links", L), ("position", I), ("relevance_label", I),
])

SCHEMAS = {"daily_metrics": DAILY, "seo_pages": SEO_PAGES, "users": USERS, "keywords": KEYWORDS}

# Feature lists (fixed values that must equal the reference's, in its order).
SALES_FEATURES = ["sessions", "ctr", "conversion_rate", "avg_position", "page_speed",
                  "content_score", "bounce_rate", "avg_time_on_site"]
PAGE_SEO_FEATURES = ["word_count", "images", "alt_ratio", "internal_links", "external_links",
                     "title_length", "meta_length", "h1_count", "page_speed", "has_schema",
                     "mobile_friendly"]
USER_FEATURES = ["sessions", "pageviews", "avg_time_on_site", "recency_days", "num_orders",
                 "total_spent"]
BEHAVIOUR_FEATURES = ["sessions", "pageviews", "avg_time_on_site", "recency_days"]
ANOMALY_FEATURES = ["visitors", "organic_traffic", "paid_traffic", "bounce_rate",
                    "avg_time_on_site", "ctr", "conversion_rate", "avg_position"]
RANKING_FEATURES = ["relevance", "word_count", "backlinks", "domain_authority", "page_speed",
                    "keyword_in_title", "keyword_in_h1", "internal_links", "keyword_difficulty",
                    "search_volume"]
TRAFFIC_LAGS = [1, 2, 3, 7, 14]
TRAFFIC_FEATURES = (["dow", "month", "roll_mean_7", "roll_std_7", "momentum_7"]
                    + [f"lag_{k}" for k in TRAFFIC_LAGS])


def require_columns(df, required, what: str = "input") -> None:
    """Raise ``ValueError`` listing the sorted missing columns (no Spark job)."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"{what} is missing required columns: {sorted(missing)}")
