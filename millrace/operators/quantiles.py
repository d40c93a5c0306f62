"""Exact quantiles of groups of any size.

A group of up to ``limit`` rows is left to Spark's exact percentile, whose buffer then
has at most as many values. In a larger group each wanted quantile is selected: a
mergeable sketch gives a bracket of values around it, the rows below and inside the
bracket are counted, and brackets that hold more than ``limit`` rows are narrowed by
a sketch of their own rows. What is left is counted by value and added up in value
order. No buffer grows with a group, only counts and bracket rows are shuffled, and
counts, not sketches, decide: a sketch that misses costs another round, never a
wrong value.

Results equal Spark's ``percentile``: at position p * (n - 1), linearly between the
two neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import written

#: ``ROUNDS`` of narrowing leave a bracket with less than a (GRID / 6) ** ROUNDS th of a group, or with equal values.
LIMIT, GRID, ROUNDS = 1_000_000, 1000, 6
VALUE = "_value"


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """``a`` joined with ``b`` on keys that may be null; the keys of ``a`` are kept. Without keys ``b`` has one row."""
    renamed = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = a.join(F.broadcast(renamed) if small else renamed, on, how) if keys else a.crossJoin(F.broadcast(renamed))
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def _grid(n: int = GRID) -> Column:
    return F.percentile_approx(VALUE, [i / n for i in range(n + 1)], 20 * n)


def _around(grid: Column, first: Column, last: Column, n: int = GRID) -> tuple[Column, Column]:
    """The grid values two cells below one share of the rows and two above another."""
    cell = lambda share: F.floor(share * n).cast("int")
    return F.element_at(grid, F.greatest(F.lit(1), cell(first) - 1)), F.element_at(grid, F.least(F.lit(n + 1), cell(last) + 4))


LOWEST, HIGHEST = float("-inf"), float("nan")  # NaN is the highest value in Spark's order


def _checked(found: DataFrame) -> DataFrame:
    """Brackets that miss their ranks are opened on that side."""
    low_miss, high_miss = F.col("first") < F.col("below"), F.col("last") >= F.col("below") + F.col("inside")
    return found.withColumns({"lower": F.when(low_miss, LOWEST).otherwise(F.col("lower")), "upper": F.when(high_miss, HIGHEST).otherwise(F.col("upper")), "missed": low_miss | high_miss})


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str], small: bool = True) -> DataFrame:
    """Brackets (keys, j, first, last, lower, upper) with the rows ``below`` and ``inside`` them.

    Rows meet one row per group that holds all its brackets, so none is multiplied.
    """
    k = brackets.agg(F.max("j")).first()[0] + 1
    wide = brackets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("lower", "upper")))).alias("b"))
    met = join_keys(rows, wide, keys, small=small)
    v, low, high = F.col(VALUE), lambda j: F.col("b")[j]["lower"], lambda j: F.col("b")[j]["upper"]
    aggs = [F.struct(F.lit(j).alias("j"), F.count_if(v < low(j)).alias("below"), F.count_if((v >= low(j)) & (v <= high(j))).alias("inside")) for j in range(k)]
    counts = met.groupBy(*keys).agg(F.array(*aggs).alias("c")).select(*keys, F.explode("c").alias("c")).select(*keys, "c.*")
    return join_keys(brackets, counts, [*keys, "j"])


def _inside(rows: DataFrame, brackets: DataFrame, keys: list[str], small: bool = True) -> DataFrame:
    """(keys, j, value) of the rows inside each bracket."""
    wide = brackets.groupBy(*keys).agg(F.collect_list(F.struct("j", "lower", "upper")).alias("b"))
    met = join_keys(rows, wide, keys, small=small)
    hit = F.filter("b", lambda b: (F.col(VALUE) >= b["lower"]) & (F.col(VALUE) <= b["upper"]))
    return met.select(*keys, VALUE, F.explode(F.transform(hit, lambda b: b["j"])).alias("j"))


def _select(rows: DataFrame, sizes: DataFrame, keys: list[str], points: list[float], limit: int) -> DataFrame:
    """(keys, n, q) of groups larger than ``limit``, of which there are at most rows / limit."""
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(a).alias("first"), F.ceil(a).alias("last"), a.alias("position")) for j, a in enumerate(at)]))
    ranks = written(sizes.select(*keys, "n", wanted.alias("w")).select(*keys, "n", "w.*"), "ranks")
    sketch = join_keys(rows, sizes.select(*keys), keys, small=True).groupBy(*keys).agg(_grid().alias("g")) if keys else rows.agg(_grid().alias("g"))
    low, high = _around(F.col("g"), F.col("first") / F.col("n"), F.col("last") / F.col("n"))
    # written, as a sketch that is merged anew in another order gives other brackets than those whose rows were counted
    first = written(join_keys(ranks, sketch, keys).select(*ranks.columns, low.alias("lower"), high.alias("upper")), "brackets")
    brackets = written(_checked(_counted(rows, first, keys)), "brackets")
    for _ in range(ROUNDS):
        todo = (F.col("missed") | (F.col("inside") > limit)) & ~F.col("lower").eqNullSafe(F.col("upper"))
        wide = brackets.filter(todo)
        if not wide.limit(1).count():
            break
        # brackets opened after a miss are counted again before they are narrowed
        open_ = written(_counted(rows, wide.drop("below", "inside", "missed"), keys), "opened")
        inner = _inside(rows, open_, keys).groupBy(*keys, "j").agg(_grid().alias("g"))
        share = lambda c: (F.col(c) - F.col("below")) / F.col("inside")
        low, high = _around(F.col("g"), share("first"), share("last"))
        narrowed = written(join_keys(open_, inner, [*keys, "j"]).select(*ranks.columns, F.greatest("lower", low).alias("lower"), F.least("upper", high).alias("upper")), "brackets")
        brackets = written(brackets.filter(~todo).unionByName(_checked(_counted(rows, narrowed, keys)).select(*brackets.columns)), "brackets")
    if brackets.filter("missed").limit(1).count():
        brackets = written(_counted(rows, brackets.drop("below", "inside", "missed"), keys), "brackets")
    counts = _inside(rows, brackets, keys).groupBy(*keys, "j", VALUE).agg(F.count(F.lit(1)).alias("c"))
    met = join_keys(counts, brackets.select(*keys, "j", "n", "first", "last", "position", "below"), [*keys, "j"])
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "j").orderBy(VALUE))
    picked = met.withColumn("upto", upto).groupBy(*keys, "j", "n", "first", "last", "position").agg(F.min(F.when(F.col("upto") > F.col("first"), F.col(VALUE))).alias("a"), F.min(F.when(F.col("upto") > F.col("last"), F.col(VALUE))).alias("b"))
    between = (F.col("last") - F.col("position")) * F.col("a") + (F.col("position") - F.col("first")) * F.col("b")
    value = F.when((F.col("first") == F.col("last")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("v")))), lambda s: s["v"])
    return picked.groupBy(*keys, "n").agg(ordered.alias("q"))


def _own(keys: list[str]) -> list[str]:
    return [f"_q{i}" for i in range(len(keys))]


def _quantiles(df: DataFrame, keys: list[str], value: Column | str, points: list[float] | tuple[float, ...], limit: int) -> DataFrame:
    """(_q0, _q1, ..., n, q): keys under names that no input column can clash with."""
    column, own = F.col(value) if isinstance(value, str) else value, _own(keys)
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], column.cast("double").alias(VALUE)).filter(F.col(VALUE).isNotNull())
    plain = lambda part: part.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.percentile(VALUE, list(points)).alias("q")).filter("n > 0")
    large = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    if not large.limit(1).count():
        return plain(rows)
    large = written(large, "large-groups")
    selected = _select(join_keys(rows, large.select(*own), own, small=True) if own else rows, large, own, list(points), limit)
    return plain(join_keys(rows, large.select(*own), own, "left_anti", small=True)).unionByName(selected) if own else selected


def exact_quantiles(df: DataFrame, keys: list[str], value: Column | str, points: list[float] | tuple[float, ...], limit: int = LIMIT) -> DataFrame:
    """(keys, n, q): the number of non-null values of each group, and their quantiles at ``points``.

    Groups may have null keys. Without keys there is one row, if there is any value.
    """
    found = _quantiles(df, keys, value, points, limit)
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, _own(keys))], "n", "q")


def with_quantiles(stats: DataFrame, rows: DataFrame, keys: list[str], value: Column | str, points: list[float] | tuple[float, ...], name: str = "_p", limit: int = LIMIT) -> DataFrame:
    """``stats`` (one row per group) with the array ``name`` of its group's quantiles, null for groups without a value."""
    found, on = _quantiles(rows, keys, value, points, limit).select(*_own(keys), F.col("q").alias(name)), F.lit(True)
    for k, o in zip(keys, _own(keys)):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return stats.join(found if keys else F.broadcast(found), on, "left").drop(*_own(keys))


def rows_of_sets(df: DataFrame, columns: list[str], sets: list[list[str]], value: Column) -> tuple[DataFrame, list[str]]:
    """(columns, flags, value): each row once per grouping set, with the flags that ``grouping`` gives, for the quantiles of grouping sets."""
    flags, types = [f"_grouping{i}" for i in range(len(columns))], dict(df.dtypes)
    one = lambda s: F.struct(
        *[(F.col(c) if c in s else F.lit(None).cast(types[c])).alias(c) for c in columns], *[F.lit(int(c not in s)).alias(f) for c, f in zip(columns, flags)]
    )
    return df.select(value.alias("_of_set"), F.inline(F.array(*map(one, sets)))), [*columns, *flags]


def long_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, value): each row once per named column."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])))


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each named column; None where it has no value."""
    found = {r["name"]: r["q"][0] for r in exact_quantiles(long_values(df, columns), ["name"], "value", [0.5]).collect()} if columns else {}
    return {n: found.get(n) for n in columns}
