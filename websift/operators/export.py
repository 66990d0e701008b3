"""Result export: JSON arrays (A8), feed items (A10), UTC dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def utc_date(ts: Column) -> Column:
    """``yyyy-MM-dd'T'HH:mm:ss'Z'`` (session time zone is UTC)."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def feed_item(title: Column, link: Column, ts: Column) -> Column:
    return F.concat(F.lit("<item><title>"), xml_escape(title), F.lit("</title><link>"), link,
                    F.lit("</link><pubDate>"), utc_date(ts), F.lit("</pubDate></item>"))


def json_results(results: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key, the result rows as one JSON array in ``order`` (bounded by the top-N cut)."""
    agg = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_r"))
    return agg.select(key, F.to_json(F.transform("_r", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
                      .alias("json"))
