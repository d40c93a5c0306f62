"""Lookups, existence, nearest donors and fallback resolution.

Dimension tables are broadcast only after their rows have been counted against
a bound; larger ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import haversine_km

SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def resolve_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: its value, or '' where rows disagree."""
    return df.groupBy(*keys).agg(F.when(F.count_distinct(value) > 1, "").otherwise(F.coalesce(F.min(value), F.lit(""))).alias(value))


def lookup(df: DataFrame, dim: DataFrame, on: list[str], value: str, default: str = "Unknown") -> DataFrame:
    """Left lookup by one or more keys with a default."""
    return df.join(small(dim.select(*on, value)), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def left_fill(df: DataFrame, other: DataFrame, on: list[str], fill: float = 0) -> DataFrame:
    return df.join(other, on, "left").fillna(fill, [c for c in other.columns if c not in on])


def exists_flag(df: DataFrame, other: DataFrame, on: list[str], column: str) -> DataFrame:
    """1 where ``other`` has the key, else 0."""
    keys = other.select(*on).distinct().withColumn(column, F.lit(1))
    return df.join(keys, on, "left").fillna(0, [column])


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def exactly_one(df: DataFrame, dim: DataFrame, on: list[str], value: str) -> DataFrame:
    """The value of the only matching row; null where several match or none."""
    single = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)).filter("_n = 1").drop("_n")
    return df.join(single, on, "left")


def conformance(left: DataFrame, right: DataFrame, on: list[str], compare: str) -> DataFrame:
    """Keys that one side lacks or on which ``compare`` differs; empty if the tables conform."""
    a, b = left.select(*on, F.col(compare).alias("left_value")), right.select(*on, F.col(compare).alias("right_value"))
    return a.join(b, on, "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two ends occur in no other pair."""
    distinct = pairs.select(a, b).distinct()
    only = lambda c: distinct.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(c)
    return distinct.join(only(a), a, "left_semi").join(only(b), b, "left_semi")


def nearest_donors(points: DataFrame, donors: DataFrame, kind: str, id_: str, k: int = 3, most_km: float = 500.0, least_n: int = 80, least_donors: int = 2) -> DataFrame:
    """For each point the k nearest donors of its kind within reach that have samples enough.

    Points and donors have (id_, kind, lat, lon) and donors n. Donors are
    regions, a bounded set: their number is checked, and cells of latitude limit
    the candidates of a point where there are more.
    """
    cell = most_km / 111.0
    d = donors.filter(F.col("n") >= least_n).select(F.col(id_).alias("donor"), F.col(kind).alias("donor_kind"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"), "n", F.floor(F.col("lat") / cell).alias("cell"))
    p = points.withColumn("cell", F.explode(F.array(*[F.floor(F.col("lat") / cell) + i for i in (-1, 0, 1)])))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("dlat"), F.col("dlon"))
    near = p.join(small(d), (p["cell"] == d["cell"]) & (p[kind] == d["donor_kind"]) & (p[id_] != d["donor"])).drop("cell").withColumn("km", km).filter(F.col("km") <= most_km)
    rank = F.row_number().over(Window.partitionBy(id_, kind).orderBy("km", "donor"))
    ranked = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    enough = F.count(F.lit(1)).over(Window.partitionBy(id_, kind)) >= least_donors
    return ranked.withColumn("_e", enough).filter("_e").select(id_, kind, "donor", "rank", "km", "n")


def resolve_levels(df: DataFrame, stats: list[tuple[str, DataFrame, list[str], int]], value: str, count: str = "n") -> DataFrame:
    """The first level whose group has rows enough: (level, table, keys, least rows), finest first."""
    level, picked, size = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")
    out, parts = df, []
    for i, (name, table, keys, least) in enumerate(stats):
        side = table.select(*keys, F.col(value).alias(f"_v{i}"), F.col(count).alias(f"_n{i}"))
        out = out.join(small(side), keys, "left")
        parts.append((name, i, least))
    for name, i, least in reversed(parts):
        ok = F.col(f"_n{i}") >= least
        level, picked, size = F.when(ok, name).otherwise(level), F.when(ok, F.col(f"_v{i}")).otherwise(picked), F.when(ok, F.col(f"_n{i}")).otherwise(size)
    return out.select(*df.columns, F.coalesce(level, F.lit("NONE")).alias("resolution_level"), picked.alias("resolved_value"), size.alias("resolved_n"))


def ecdf_weight(km: Column, n: Column) -> Column:
    """Weight of a donor's row: 1 / (max(km, 25) * rows of the donor)."""
    return 1 / (F.greatest(km, F.lit(25.0)) * n)
