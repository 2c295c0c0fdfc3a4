"""Small column builders shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# Spellings of "nothing here" in stringified dictionaries and lists.
ABSENT_TEXTS = ("", "null", "None", "{}", "[]")


def is_present(c: Column) -> Column:
    """True when a stringified dict/list really holds something; never null."""
    return F.coalesce(~F.trim(c).isin(*ABSENT_TEXTS), F.lit(False))


def truthy(c: Column) -> Column:
    """Null-safe boolean: null counts as false."""
    return F.coalesce(c, F.lit(False))


def below(c: Column, bands: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """First band whose exclusive upper bound lies above ``c``; null goes to ``otherwise``."""
    out: Column | None = None
    for bound, value in bands:
        hit = c < F.lit(bound)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def at_least(c: Column, bands: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """First band whose inclusive lower bound is reached by ``c``."""
    out: Column | None = None
    for bound, value in bands:
        hit = c >= F.lit(bound)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def above(c: Column, bands: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """First band whose exclusive lower bound is exceeded by ``c``."""
    out: Column | None = None
    for bound, value in bands:
        hit = c > F.lit(bound)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def settled(c: Column) -> Column:
    """A computed double without its last digits, so that a threshold test does not
    depend on the order in which partitions were added up."""
    return F.round(c, 12)


def unit_interval(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ratio(part: Column, total: Column, empty: float | None = None) -> Column:
    """``part / total`` without ANSI division errors; ``empty`` when total is 0 or null."""
    value = F.when(total != 0, part / total)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def priority_order(c: Column) -> Column:
    """high, medium, low; anything else last."""
    return F.when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(4)


def listed_names(c: Column) -> Column:
    """Number of names inside a stringified list such as ``['dt', 'region']``."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"\s]", "")
    return F.size(F.filter(F.split(bare, ","), lambda x: x != ""))


# ---------------------------------------------------------------- tags

# Allocation dimensions and the two accepted spellings of each key.
TAG_KEYS: dict[str, tuple[str, str]] = {
    "cost_center": ("cost_center", "CostCenter"),
    "business_unit": ("business_unit", "BusinessUnit"),
    "data_domain": ("data_domain", "DataDomain"),
    "project": ("project", "Project"),
    "owner": ("owner", "Owner"),
}
UNALLOCATED = "unallocated"


def tags_struct(raw: Column) -> Column:
    """The five allocation tags of a JSON text as a struct; missing ones are ''."""
    tags = F.from_json(raw, "map<string,string>")
    return F.struct(
        *[
            F.coalesce(*[F.nullif(tags[key], F.lit("")) for key in keys], F.lit("")).alias(name)
            for name, keys in TAG_KEYS.items()
        ]
    )


def shown_tag(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNALLOCATED))


# ---------------------------------------------------------------- workspace URLs

# Host patterns that tell the cloud, tested in this order.
CLOUD_HOST_MARKS: tuple[tuple[str, Sequence[str]], ...] = (
    ("azure", ("azuredatabricks.net", "adb-")),
    ("gcp", ("gcp.databricks.com",)),
    ("aws", ("cloud.databricks.com",)),
)
WORKSPACE_URL_PATTERN = (
    r"https://([^.]+)\.(?:azuredatabricks\.net|cloud\.databricks\.com|gcp\.databricks\.com)"
)


def cloud_from_url(url: Column) -> Column:
    """azure / gcp / aws, or null when the host is unknown."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for cloud, marks in CLOUD_HOST_MARKS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | url.contains(mark)
        out = out.when(hit, F.lit(cloud))
    return out


def workspace_id_from_url(url: Column) -> Column:
    """First host label of a workspace URL, or null when the URL does not match."""
    return F.nullif(F.regexp_extract(url, WORKSPACE_URL_PATTERN, 1), F.lit(""))
