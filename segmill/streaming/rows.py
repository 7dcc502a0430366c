"""Row-wise operators on streams: what needs no other row works unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions import tokens as tk


def tokenized_stream(stream: DataFrame, text: str = "text", tokenizer: str = "whitespace") -> DataFrame:
    """The stream with segment, the lower-cased tokens of a text column; null text has none."""
    return stream.withColumn("segment", tk.lowercased(tk.tokenizer(tokenizer)(F.coalesce(F.col(text), F.lit("")))))


def windowed_frequency(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", segment: str = "segment") -> DataFrame:
    """window, token, n: counts of tokens by window of event time; rows later than the watermark are dropped by Spark."""
    tokens = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(time, F.explode(segment).alias("token"))
    return tokens.groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("n"))
