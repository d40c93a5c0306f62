"""Market statistics: levels, regional donors, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import weighted_quantiles
from millrace.operators.joins import ecdf_weight, nearest_donors, small


def regional_quantiles(values: DataFrame, centers: DataFrame, region: str, kind: str, value: str, **limits) -> DataFrame:
    """Weighted quartiles of a region's nearest donors, with each donor's share of the weight.

    values: (region, kind, value) rows; centers: (region, lat, lon), one row per region.
    """
    sizes = values.groupBy(region, kind).agg(F.count(F.lit(1)).alias("n"))
    donors = sizes.join(small(centers), region)
    points = centers.crossJoin(small(sizes.select(kind).distinct()))  # regions by kinds, both checked small sets
    near = nearest_donors(points, donors, kind, region, **limits)
    rows = values.select(F.col(region).alias("donor"), kind, value)
    weighted = near.join(rows, ["donor", kind]).withColumn("weight", ecdf_weight(F.col("km"), F.col("n")))
    quantiles = weighted_quantiles(weighted, [region, kind], value, "weight")
    total = F.sum("w").over(Window.partitionBy(region, kind))
    shares = near.withColumn("w", 1 / F.greatest(F.col("km"), F.lit(25.0))).withColumn("province_weight", F.round(F.col("w") / total, 6))
    listed = shares.groupBy(region, kind).agg(F.array_sort(F.collect_list(F.struct("rank", "donor", "n", F.round("km", 3).alias("distance_km"), "province_weight"))).alias("donors"))  # at most k donors
    return quantiles.join(listed, [region, kind])


def region_key(df: DataFrame, province: str, area: str, least: int = 30) -> DataFrame:
    """Adds ``region``: province and area, or the province alone where the pair has few rows."""
    counts = df.groupBy(province, area).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(counts, [province, area], "left")
    whole = F.concat_ws("|", province, area)
    return joined.withColumn("region", F.when(F.col("_n") >= least, whole).otherwise(F.concat(F.lit("__province__"), F.col(province)))).drop("_n")


def house_features(area: Column, rooms: dict[str, Column]) -> dict[str, Column]:
    """log area, and for each room count its value with a flag for a missing one."""
    out = {"log_area": F.log1p(area)}
    for name, c in rooms.items():
        out |= {name: F.coalesce(c.cast("double"), F.lit(0.0)), f"{name}_missing": c.isNull().cast("int")}
    return out


def estimate(area: Column, p25: Column, median: Column, p75: Column) -> dict[str, Column]:
    return {"low": area * p25, "value": area * median, "high": area * p75}
