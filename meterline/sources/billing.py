"""Readers of the three clouds' billing exports and their common feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.functions import timeutil as T
from meterline.schemas import struct_of

_ENVELOPE = "workspace_name string, workspace_url string, collected_at bigint"

AZURE_LINE = f"{_ENVELOPE}, columns array<struct<name:string>>, rows array<array<string>>"

AWS_LINE = f"""{_ENVELOPE},
ResultsByTime array<struct<TimePeriod:struct<Start:string,End:string>,Estimated:boolean,
  Groups array<struct<Keys:array<string>,
    Metrics:struct<UnblendedCost:struct<Amount:string,Unit:string>>>>>>"""
AWS_LINE = AWS_LINE.replace("Groups array", "Groups:array")

GCP_TABLE = """workspace_name string, workspace_url string, usage_start_time timestamp,
service struct<description:string>, resource struct<name:string>, cost double, currency string,
collected_at bigint, table_suffix string"""

# Result columns of the Azure cost query and the currency of feeds without one.
AZURE_COLUMNS = {
    "date": "UsageDate",
    "resource_id": "ResourceId",
    "resource_type": "ResourceType",
    "resource_group": "ResourceGroupName",
    "cost": "PreTaxCost",
    "currency": "Currency",
}
DEFAULT_CURRENCY = "USD"


def _stamp():
    return F.timestamp_millis("collected_at").alias("collect_timestamp")


def _iso_date(text):
    """``20240131`` or ``2024-01-31...`` as ``2024-01-31``."""
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.substring(compact, 1, 10)


def read_billing_azure(spark: SparkSession, path: str) -> DataFrame:
    """Cost query pages: rows are matched to columns by name, not by position."""
    pages = spark.read.schema(struct_of(AZURE_LINE)).json(path)
    names = F.transform("columns", lambda c: c["name"])
    rows = pages.select(
        "workspace_name", "workspace_url", "collected_at", names.alias("names"),
        F.explode("rows").alias("row"),
    )

    def cell(field: str):
        at = F.array_position("names", AZURE_COLUMNS[field]).cast("int")
        return F.when(at > 0, F.get("row", at - 1))

    return rows.select(
        "workspace_name",
        "workspace_url",
        F.lit("azure").alias("cloud"),
        _iso_date(cell("date")).alias("date"),
        cell("resource_id").alias("resource_id"),
        cell("resource_type").alias("resource_type"),
        cell("resource_group").alias("resource_group"),
        F.coalesce(cell("cost").try_cast("double"), F.lit(0.0)).alias("cost"),
        F.coalesce(cell("currency"), F.lit(DEFAULT_CURRENCY)).alias("currency"),
        _stamp(),
    )


def read_billing_aws(spark: SparkSession, path: str) -> DataFrame:
    """Cost pages: one row per day and (service, resource); currency is the amount's unit."""
    pages = spark.read.schema(struct_of(AWS_LINE)).json(path)
    days = pages.select(
        "workspace_name", "workspace_url", "collected_at", F.explode("ResultsByTime").alias("day")
    )
    groups = days.select(
        "workspace_name",
        "workspace_url",
        "collected_at",
        F.col("day.TimePeriod.Start").alias("date"),
        F.explode("day.Groups").alias("g"),
    )
    cost = F.col("g.Metrics.UnblendedCost")
    return groups.select(
        "workspace_name",
        "workspace_url",
        F.lit("aws").alias("cloud"),
        "date",
        F.get("g.Keys", 0).alias("service"),
        F.get("g.Keys", 1).alias("resource_id"),
        F.coalesce(cost["Amount"].try_cast("double"), F.lit(0.0)).alias("cost"),
        F.coalesce(cost["Unit"], F.lit(DEFAULT_CURRENCY)).alias("currency"),
        _stamp(),
    )


def read_billing_gcp(
    spark: SparkSession, path: str, *, as_of: int, days_back: int = 30
) -> DataFrame:
    """Billing export table; the range on the day suffix skips whole folders."""
    days = [
        F.date_format(F.date_sub(T.as_of_ts(as_of).cast("date"), n), "yyyyMMdd")
        for n in (days_back, 0)
    ]
    rows = spark.read.schema(struct_of(GCP_TABLE)).parquet(path)
    return rows.filter(F.col("table_suffix").between(*days)).select(
        "workspace_name",
        "workspace_url",
        F.lit("gcp").alias("cloud"),
        F.date_format("usage_start_time", "yyyy-MM-dd").alias("date"),
        F.col("service.description").alias("service"),
        F.col("resource.name").alias("resource_id"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        _stamp(),
    )


def unified_billing(*feeds: DataFrame) -> DataFrame:
    """All feeds in one frame; columns a cloud does not report are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
