"""Call logs and spans: content kept out of attributes, and metrics of tools, errors, retrieval and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes that may hold what was asked or read.
STRIPPED = [
    "question.text", "query.text", "sparql.query", "document.content", "chunk.text", "db.statement", "db.query.text", "http.url", "url.full", "url.query",
    "http.request.body", "gen_ai.prompt", "gen_ai.completion", "exception.message", "exception.stacktrace",
]


def redacted(attributes: Column) -> Column:
    """A map of attributes without those that may hold content."""
    return F.map_filter(attributes, lambda k, _: ~k.isin(STRIPPED))


def redact(spans: DataFrame) -> DataFrame:
    """Spans (attributes, events, ...) with the attributes of both stripped; events are an array of (name, attributes)."""
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), redacted(e["attributes"]).alias("attributes")))
    return spans.withColumn("attributes", redacted(F.col("attributes"))).withColumn("events", events)


def durations(calls: DataFrame, by: list[str], value: str = "duration_ms") -> DataFrame:
    """(*by, calls, mean_ms, most_ms) of calls."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.avg(value), 6).alias("mean_ms"), F.max(value).alias("most_ms"))


def errors(calls: DataFrame) -> DataFrame:
    """(tool, error_type, errors) of calls (tool, error_type); a null type is no error."""
    return calls.where("error_type is not null").groupBy("tool", "error_type").agg(F.count("*").alias("errors"))


def model_share(routes: DataFrame, by: list[str]) -> DataFrame:
    """(*by, share): which part of the routes (decided_by) the model decided; 0 where nothing was routed."""
    return routes.groupBy(*by).agg(F.round(F.count_if(F.col("decided_by") == "model") / F.count("*"), 6).alias("share"))
