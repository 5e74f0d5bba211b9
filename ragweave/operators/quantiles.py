"""Exact order statistics without gathering a group, and quantile sketches that can be kept and merged.

``order_statistics`` narrows the range that holds each wanted rank. A mergeable summary of the values in
the range proposes two of them around the rank; one pre-aggregated pass counts the values below, at, between
and above these, which settles the rank or gives its next range, exactly. A pass leaves about a fiftieth of
the values, whatever their distribution, and equal values settle at once; what is left is gathered when no
range has over ``LIMIT`` values. A task therefore holds counters and at most ``LIMIT`` values of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.storage import discard, materialize

#: Values of a group that may be gathered for a rank, proposed values, and the summary's accuracy.
LIMIT, GRID, ACCURACY = 2048, 128, 4096
#: Whole and decimal numbers while distances are taken.
WIDE = "decimal(38,9)"


def _summary(kind: str) -> Column:
    """Shares of the values of a range, from a mergeable summary.

    The summary works in doubles; what isn't a double is taken as its distance from the range's base, so
    that large whole numbers can be told apart once their range is narrow.
    """
    shares = [i / GRID for i in range(GRID + 1)]
    value = F.col("v") if kind in ("double", "float") else (F.col("v").cast(WIDE) - F.col("base").cast(WIDE)).cast("double")
    return F.percentile_approx(value, shares, ACCURACY)


def _proposed(rank: Column, n: Column, grid: Column, kind: str) -> list[Column]:
    """Two values of a range's summary that should lie around its ``rank`` of ``n``."""
    at = rank * GRID / n
    lo, hi = F.greatest(F.floor(at) - 1, F.lit(0)), F.least(F.ceil(at) + 1, F.lit(GRID))
    found = [F.get(grid, x.cast("int")) for x in (lo, hi)]
    if kind not in ("double", "float"):
        found = [(F.col("base").cast(WIDE) + x.cast(WIDE)).cast(kind) for x in found]
    return [x.alias(name) for x, name in zip(found, ("lo", "hi"))]


def _narrowed(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The state after one pass: ``settled``, or the open range (from, to) of ``n_in`` values that has the rank."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    tally = _inside(values, state, keys).groupBy(*keys, "name").agg(
        F.count_if(v < lo).alias("lt"), F.count_if(v == lo).alias("at_lo"), F.count_if((v > lo) & (v < hi)).alias("mid"), F.count_if((v == hi) & (hi > lo)).alias("at_hi"), F.count("*").alias("all")
    )
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "name"]]
    both = state.alias("s").join(tally.alias("t"), same).select("s.*", "lt", "at_lo", "mid", "at_hi", "all")
    ends = [F.col("lt"), F.col("lt") + F.col("at_lo"), F.col("lt") + F.col("at_lo") + F.col("mid"), F.col("lt") + F.col("at_lo") + F.col("mid") + F.col("at_hi")]
    r = F.col("rank") - F.col("below")
    step = F.when(r <= ends[0], 0).when(r <= ends[1], 1).when(r <= ends[2], 2).when(r <= ends[3], 3).otherwise(4)
    out = both.withColumn("step", step)
    pick = lambda *x: F.get(F.array(*x), F.col("step"))
    none = F.lit(None)
    return out.select(
        *keys, "name", "rank",
        pick(F.col("from"), none, lo, none, hi).alias("from"),
        pick(lo, none, hi, none, F.col("to")).alias("to"),
        (F.col("below") + pick(F.lit(0).cast("long"), F.lit(0).cast("long"), ends[1], F.lit(0).cast("long"), ends[3])).alias("below"),
        pick(F.col("lt"), none, F.col("mid"), none, F.col("all") - ends[3]).alias("n_in"),
        pick(none, lo, none, hi, none).alias("settled"),
        F.coalesce(pick(F.col("from"), none, lo, none, hi), F.col("base")).alias("base"),
    )


def _inside(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each state row whose open range has them; the state is a written table of a row a group and rank."""
    own = state.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in state.columns if c not in keys])
    fits = (F.col("from").isNull() | (F.col("v") > F.col("from"))) & (F.col("to").isNull() | (F.col("v") < F.col("to")))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return values.join(own, [*same, fits] if same else fits).drop(*[f"of_{k}" for k in keys])


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``group``, n, and for each name of ``ranks`` the value whose rank from 1 it gives for n values.

    Null values aren't counted, a rank outside 1 to n gives null, groups without values have no row.
    """
    keys = [f"g{i}" for i in range(len(group))]
    values = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).alias("v")).filter("v is not null")
    sizes = materialize(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("n > 0"), "quantile-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= LIMIT:
        each = values.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.count("*").alias("n"))
        picked = [F.get("vs", rank(F.col("n")).cast("int") - 1).alias(name) for name, rank in ranks.items()]
        return each.filter("n > 0").select(*[F.col(k).alias(g) for g, k in zip(group, keys)], "n", *picked)
    kind = dict(values.dtypes)["v"]
    none = lambda name: F.lit(None).cast(kind).alias(name)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    state = sizes.select(*keys, "n", "least", F.inline(wanted)).filter("rank between 1 and n")
    state = materialize(state.select(*keys, "name", "rank", none("from"), none("to"), F.lit(0).cast("long").alias("below"), F.col("n").alias("n_in"), F.col("least").alias("base")), "quantile-state")
    size = state.agg(F.sum("n_in")).first()[0] or 0
    done = []
    while most > LIMIT:
        summary = _inside(values, state, keys).groupBy(*keys, "name").agg(_summary(kind).alias("grid"))
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "name"]]
        proposed = state.alias("s").join(summary.alias("t"), same).select("s.*", *_proposed(F.col("rank") - F.col("below"), F.col("n_in"), F.col("grid"), kind))
        proposed = materialize(proposed, "quantile-bounds")
        now = materialize(_narrowed(values, proposed, keys), "quantile-state")
        done.append(now.filter("settled is not null").select(*keys, "name", F.col("settled").alias("v")))
        for old in (state, proposed):
            discard(old)
        state = now.filter("settled is null").drop("settled")
        most, left = (x or 0 for x in state.agg(F.max("n_in"), F.sum("n_in")).first())
        if left >= size:
            raise RuntimeError(f"the values of {value} can't be told apart")
        size = left
    last = _inside(values, state, keys).groupBy(*keys, "name", (F.col("rank") - F.col("below")).alias("at")).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = last.select(*keys, "name", F.get("vs", F.col("at").cast("int") - 1).alias("v"))
    for x in done:
        found = found.unionByName(x)
    found = found.groupBy(*keys).pivot("name", list(ranks)).agg(F.first("v"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = sizes.alias("s").join(found.alias("t"), same or F.lit(True), "left")
    return joined.select(*[F.col(f"s.{k}").alias(g) for g, k in zip(group, keys)], "n", *[F.col(f"t.`{name}`").alias(name) for name in ranks])


def percentiles(rows: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``group``, n, and each wanted share's quantile, linear between neighbours."""
    at = lambda n, p: (n - 1) * F.lit(p)
    ranks = {}
    for name, p in wanted.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor(at(n, p)) + 1
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil(at(n, p)) + 1
    found = order_statistics(rows, group, value, ranks)
    part = lambda p: at(F.col("n"), p) - F.floor(at(F.col("n"), p))
    return found.select(*group, "n", *[(F.col(f"{x}_lo") * (1 - part(p)) + F.col(f"{x}_hi") * part(p)).alias(x) for x, p in wanted.items()])


def sketches(rows: DataFrame, group: list[str | Column], value: str, k: int = 200) -> DataFrame:
    """``group`` and a KLL sketch of its values, of a few KB whatever their number; sketches can be stored and merged."""
    return rows.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(kept: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of coarser groups, from kept ones alone."""
    return kept.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(kept: DataFrame, group: list[str], shares: list[float]) -> DataFrame:
    """``group``, share, n and the approximate quantile of each share."""
    each = F.array(*[F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("quantile")) for s in shares])
    return kept.select(*group, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(each)).select(*group, "share", "n", "quantile")


def rank_errors(rows: DataFrame, group: list[str], value: str, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` with rank_error: how far the share of values below or at each lies from its share, exactly counted.

    An estimate that equals many values covers a span of ranks; its error is the distance to that span.
    """
    keys = [f"g{i}" for i in range(len(group))]
    asked = quantiles.select(*[F.col(g).alias(f"of_{k}") for g, k in zip(group, keys)], "share", "n", "quantile")
    values = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).cast("double").alias("v")).filter("v is not null")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    counted = values.join(asked, same).groupBy(*keys, "share", "n", "quantile").agg(F.count_if(F.col("v") < F.col("quantile")).alias("below"), F.count_if(F.col("v") <= F.col("quantile")).alias("upto"))
    lo, hi = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    error = F.greatest(F.lit(0.0), lo - F.col("share"), F.col("share") - hi)
    return counted.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], "share", "n", "quantile", error.alias("rank_error"))
