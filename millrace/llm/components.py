"""Connected components of an edge table, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def dealt_anew(df: DataFrame, column: str, key: str = "join_key") -> DataFrame:
    """``df`` with ``key``, a bijection of an id column (a long, or else by its text).

    A join on it shuffles both sides for the join itself, so that adaptive
    execution may split a hot key; a side that is still dealt by a former
    aggregation could not be split.
    """
    return df.withColumn(key, key_of(df, column))


def key_of(df: DataFrame, column: str):
    return F.bitwise_not(F.col(column)) if dict(df.dtypes)[column] == "bigint" else F.concat(F.col(column).cast("string"), F.lit(""))


#: Bytes up to which a table is broadcast, by its values alone.
SMALL = 16 << 20
WIDTHS = {"bigint": 8, "double": 8, "int": 4, "boolean": 1}


def size_checked(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if its values have at most ``limit`` bytes; else as it is, for a shuffled join.

    Numbers count by their width, strings by their length, and arrays by 8
    bytes for each number in an element; a row counts as 8 bytes besides.
    """
    fixed = 8 + sum(WIDTHS.get(t, 0) for _, t in df.dtypes)
    length = lambda c, t: F.coalesce(8 * max(1, t.count(":")) * F.size(c) if t.startswith("array") else F.octet_length(c), F.lit(0))
    wide = [F.sum(length(F.col(c), t)) for c, t in df.dtypes if t not in WIDTHS]
    n, *lengths = df.agg(F.count(F.lit(1)), *wide).first()
    return F.broadcast(df) if n * fixed + sum(x or 0 for x in lengths) <= limit else df


def _with_minimum(pairs: DataFrame, minimum) -> DataFrame:
    """pairs (u, v) with ``m``, the aggregate of the v of each u (combined before the shuffle)."""
    mins = dealt_anew(pairs.groupBy("u").agg(minimum.alias("m")), "u").select("join_key", "m")
    return dealt_anew(pairs, "u").join(mins, "join_key").select("u", "v", "m")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every u has one v and no v is a u itself: then each v is the root of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``edges``; the component is its smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    only stars are left. Each round is written to the shared folder and read
    again. Self-loops and null ends are ignored; without edges the result is empty.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    done = False
    while not done:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, F.least(F.min("v"), F.first("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_minimum(large, F.min("v"))
        # every edge (u, v) becomes (v, m), and (u, m) joins them
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = materialize(small.select(ends.alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        discard(now)
        now, done = new, _is_forest_of_stars(new)
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return materialize(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")


def merge_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after adding ``links`` (a, b): only the graph between components is walked again."""
    label = lambda df, c: dealt_anew(df, c, "k").join(components.select(F.bitwise_not("id").alias("k"), "component"), "k", "left").withColumn(c, F.coalesce("component", c)).drop("k", "component")
    over = connected_components(materialize(label(label(links.select("a", "b"), "a"), "b"), "component-links"))
    moved = dealt_anew(components, "component", "k").join(over.select(F.bitwise_not("id").alias("k"), F.col("component").alias("to")), "k", "left")
    old = moved.select("id", F.coalesce("to", "component").alias("component"))
    # ids that only the new links have
    fresh = over.join(components.select(F.col("id").alias("known")), F.col("id") == F.col("known"), "left_anti")
    return materialize(old.unionByName(fresh.select("id", "component")), "components")
