"""Streaming extras: counts that add up as documents arrive. The reference has no streaming; these go beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graphs


def pair_counts(stream: DataFrame, window: int = 2, text_col: str = "text") -> DataFrame:
    """(a, b, n) of a stream of texts, for output mode `update` or `complete`: pair counts are additive, so each batch adds to them."""
    tokens = stream.select(X.tokenize(F.lower(F.coalesce(text_col, F.lit("")))).alias("tokens"))
    return graphs.pair_counts(tokens, window)


def recent_events(stream: DataFrame, seconds: int = 60, slide: int = 1, late: str = "2 minutes") -> DataFrame:
    """(user_id, window, n): events a user in sliding windows, with a watermark for late ones."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.window("at", f"{seconds} seconds", f"{slide} seconds")).agg(F.count(F.lit(1)).alias("n"))
