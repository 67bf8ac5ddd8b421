"""Choices of columns by their names and types: plain functions of a schema, nothing is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

# Families of columns, their prefixes, what is never a feature.
SENSORS = ["modis", "landsat", "s1", "s2", "s3"]
WEATHER, ANALYSIS, DERIVED = "era5_", "mesan_", "derived_"
NO_ANALYSIS = ["mesan_product"]
NO_SATELLITE = ("_offset", "_obs", "_product")
ALGORITHMS = ["chl_a", "turbidity", "secchi", "cdom"]
TIERS = {"static": ["static"], "met": ["static", "weather"], "met_mesan": ["static", "weather", "analysis"], "published_alg": ["published"], "full": ["static", "weather", "analysis", "satellite"]}


def distinct_names(names: list[str]) -> list[str]:
    """The names in order, each once."""
    return list(dict.fromkeys(names))


def tier_columns(schema: StructType, tier: str, static: list[str]) -> list[str]:
    """The feature columns of a tier in the schema's order within each family; none for an unknown tier. Columns with the prefix derived_ are never features, as they leak targets."""
    names = [f.name for f in schema if not f.name.startswith(DERIVED)]
    numeric = {f.name for f in schema if isinstance(f.dataType, NumericType)}
    sensed = [n for n in names if n in numeric and n.startswith(tuple(f"{s}_" for s in SENSORS))]
    family = {
        "static": [n for n in static if n in names],
        "weather": [n for n in names if n.startswith(WEATHER)],
        "analysis": [n for n in names if n.startswith(ANALYSIS) and n not in NO_ANALYSIS],
        "satellite": [n for n in sensed if not n.endswith(NO_SATELLITE)],
        "published": [n for n in sensed if any(a in n for a in ALGORITHMS)],
    }
    return distinct_names([n for f in TIERS.get(tier, []) for n in family[f]])


def scale_by_prefix(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns with one of the prefixes divided by its factor."""
    return df.withColumns({c: F.col(c) / f for p, f in factors.items() for c in df.columns if c.startswith(p)})
