"""sprout: a Spark-native growth-analytics engine.

Daily site metrics, page facts, visitor behaviour and keyword candidates go in;
health scores, recommendations, forecasts, segments, customer scores, keyword
rankings, anomalous days and cycle-over-cycle alerts come out, all as
DataFrames keyed by site or series so that many sites run in one job.
"""

__version__ = "0.1.0"
