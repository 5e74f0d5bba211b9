"""Order within groups of any size: ranges of the order are windows of their own, small tables carry what crosses them.

A window over a group sorts the whole group in one task. Here the order is cut at quantiles into as many ranges
as there are shuffle partitions; each (group, range) is a window, and of each a few numbers (its rows, sums, first
and last row) are aggregated before any shuffle. The table of these, at most ranges x groups rows, says
what stands before and behind a range. Rows without an order come last; equal ones follow the tie column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.storage import materialize

RANGE = "__range"


def dealt(rows: DataFrame, order: str, other: DataFrame | None = None) -> list[DataFrame]:
    """``rows`` (and ``other``) with the range that a numeric ``order`` falls in, by quantiles of ``rows``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    above = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col(order).cast("double")))
    at = F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(above)
    return [d.withColumn(RANGE, at) for d in ([rows] if other is None else [rows, other])]


def _key(order: str, tie: str) -> list[Column]:
    return [F.col(order).isNull(), F.col(order), F.col(tie)]


def _struct(order: str, tie: str) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(_key(order, tie), ("none", "at", "tie"))])


def _with_edges(rows: DataFrame, edges: DataFrame, group: Sequence[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` that the written table ``edges`` has for their group and range."""
    own = edges.select(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)], F.col(RANGE).alias("__of"), *names)
    same = [F.col(RANGE) == F.col("__of"), *(F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group))]
    return rows.join(own, same).drop("__of", *[f"__g{i}" for i in range(len(group))])


def running(rows: DataFrame, group: Sequence[str], order: str, tie: str, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the group up to each row (or before it)."""
    cut = dealt(rows.withColumn("__value", value), order)[0]
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy(*group, RANGE).agg(F.sum("__value").alias("__sum"))
    edges = materialize(edges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum"), "range-sums")
    inside = Window.partitionBy(*group, RANGE).orderBy(*_key(order, tie)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = F.coalesce(F.sum("__value").over(inside), F.lit(0)) + F.col("__before")
    return _with_edges(cut, edges, group, ["__before"]).withColumn(name, total).drop("__value", "__before", RANGE)


def numbered(rows: DataFrame, group: Sequence[str], order: str, tie: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their number in the group from 1."""
    return running(rows, group, order, tie, F.lit(1).cast("long"), name)


def _edges(cut: DataFrame, group: Sequence[str], order: str, id_col: str) -> DataFrame:
    """(group, range, __previous, __next): the last row before and the first behind each range that has rows."""
    first, last = (f(_struct(order, id_col)).alias(n) for f, n in ((F.min, "__first"), (F.max, "__last")))
    ends = cut.groupBy(*group, RANGE).agg(first, last)
    line = Window.partitionBy(*group).orderBy(RANGE)
    return ends.withColumns({"__previous": F.lag("__last").over(line)["tie"], "__next": F.lead("__first").over(line)["tie"]})


def with_neighbours(rows: DataFrame, group: Sequence[str], order: str, id_col: str, previous: str = "previous_id", following: str = "next_id") -> DataFrame:
    """``rows`` with the ids of the rows before and after each in its group."""
    cut = dealt(rows, order)[0]
    edges = materialize(_edges(cut, group, order, id_col).select(*group, RANGE, "__previous", "__next"), "range-ends")
    inside = Window.partitionBy(*group, RANGE).orderBy(*_key(order, id_col))
    held = F.struct(F.col(id_col).alias("id"))
    near = cut.withColumns({"__lag": F.lag(held).over(inside), "__lead": F.lead(held).over(inside)})
    found = _with_edges(near, edges, group, ["__previous", "__next"])
    pick = lambda own, far: F.when(F.col(own).isNull(), F.col(far)).otherwise(F.col(f"{own}.id"))
    return found.withColumns({previous: pick("__lag", "__previous"), following: pick("__lead", "__next")}).drop("__lag", "__lead", "__previous", "__next", RANGE)


def nearest_around(hits: DataFrame, rows: DataFrame, group: Sequence[str], order: str, id_col: str, previous: str = "previous_id", following: str = "next_id") -> DataFrame:
    """``hits`` with the ids of the nearest ``rows`` of their group before and after (order, id): an as-of join both ways.

    Hits and rows are merged in windows of (group, range); only ranges that have a hit are sorted, and what
    lies beyond a range comes from the edges of the others. A row that equals a hit is neither neighbour.
    """
    cut, asked = dealt(rows.select(*group, order, id_col), order, hits)
    asked = materialize(asked.withColumn("__hit", F.monotonically_increasing_id()), "asked")
    spots = asked.select(*group, RANGE).distinct()
    sides = {"__first": F.min, "__last": F.max}
    ends = materialize(cut.groupBy(*group, RANGE).agg(*[f(_struct(order, id_col)).alias(n) for n, f in sides.items()]), "range-ends")
    # ranges with rows and ranges with hits, to carry the edges to the latter
    line = Window.partitionBy(*group).orderBy(RANGE)
    both = ends.unionByName(spots, allowMissingColumns=True).groupBy(*group, RANGE).agg(F.first("__first", True).alias("__first"), F.first("__last", True).alias("__last"))
    up, down = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    edges = materialize(both.withColumns({"__previous": F.last("__last", True).over(up)["tie"], "__next": F.last("__first", True).over(down)["tie"]}).select(*group, RANGE, "__previous", "__next"), "range-edges")
    names = [*group, RANGE]
    spot = materialize(spots.select(*[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(names)]), "spots")
    near = cut.join(spot, [F.col(f"`{c}`").eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(names)], "left_semi")
    held = F.struct(F.col(id_col).alias("id"))
    none = F.lit(None)
    merged = near.select(*names, order, id_col, none.cast("long").alias("__hit"), held.alias("__row")).unionByName(asked.select(*names, order, id_col, "__hit", none.alias("__row")))
    # a hit comes before an equal row, in either direction
    asc = Window.partitionBy(*names).orderBy(*_key(order, id_col), F.col("__hit").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    desc = Window.partitionBy(*names).orderBy(*[F.desc(c) for c in _key(order, id_col)], F.col("__hit").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = merged.withColumns({"__lag": F.last("__row", True).over(asc), "__lead": F.last("__row", True).over(desc)}).filter("__hit is not null")
    pick = lambda own, far: F.when(F.col(own).isNull(), F.col(far)).otherwise(F.col(f"{own}.id"))
    found = _with_edges(seen, edges, group, ["__previous", "__next"]).select(F.col("__hit").alias("__of_hit"), pick("__lag", "__previous").alias(previous), pick("__lead", "__next").alias(following))
    return asked.join(found, F.col("__hit") == F.col("__of_hit")).drop("__hit", "__of_hit", RANGE)
