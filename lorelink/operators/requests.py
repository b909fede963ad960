"""Requests: how HTTP bodies, files and tables become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kb import KB


def from_http(rows: DataFrame) -> DataFrame:
    """request_id, text, status of rows with method, content_type, query_text, form_text and body.

    GET takes its text from the query, a form from its field, plain text from the body. Other kinds of content are status
    415, no text at all 400.
    """
    kind = F.lower(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))
    form = kind.isin("application/x-www-form-urlencoded", "multipart/form-data")
    text = F.when(F.col("method") == "GET", F.col("query_text")).when(form, F.col("form_text")).when(kind == "text/plain", F.col("body"))
    known = (F.col("method") == "GET") | form | (kind == "text/plain")
    status = F.when(~known, 415).when(text.isNull(), 400).otherwise(200)
    return rows.select(F.coalesce("request_id", F.expr("uuid()")).alias("request_id"), text.alias("text"), status.alias("status"))


def usage(kb: KB) -> DataFrame:
    """The languages that can be asked for."""
    return kb.languages()
