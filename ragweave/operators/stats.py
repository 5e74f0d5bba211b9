"""Latency and load-test statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.operators import quantiles

# Upper bounds of latency buckets in milliseconds.
BOUNDS = (1, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16364)


def latency(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, p50 and p99 (linear) of each group; no task gathers a group's values."""
    means = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    exact = quantiles.percentiles(rows, group, value, {"p50": 0.5, "p99": 0.99})
    return _beside(means, exact, group, ["p50", "p99"])


def _beside(rows: DataFrame, found: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the ``columns`` of ``found`` for equal ``group``, null included; both have a row a group."""
    same = [F.col(f"r.`{g}`").eqNullSafe(F.col(f"f.`{g}`")) for g in group]
    return rows.alias("r").join(found.alias("f"), same or F.lit(True), "left").select("r.*", *[F.col(f"f.`{c}`") for c in columns])


def exclusive_p90(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, p90) by the exclusive method of quantiles; groups of one value have null."""
    m = lambda n: n + 1
    j = lambda n: F.greatest(F.lit(1), F.least(F.floor(m(n) * 9 / 10), n - 1))
    found = quantiles.order_statistics(rows, group, value, {"a": j, "b": lambda n: j(n) + 1})
    rest = 9 * m(F.col("n")) - 10 * j(F.col("n"))
    return found.select(*group, F.when(F.col("n") > 1, (F.col("a") * (10 - rest) + F.col("b") * rest) / 10).alias("p90"))


def histogram(rows: DataFrame, group: list[str], value: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts of values at most each bound (le), and of all (le null)."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*group).agg(*counts, F.count(value).alias("rest"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("rest").alias("n")))
    return wide.select(*group, F.inline(pairs))


# The columns of a load test's file, which has no header.
LOAD_TEST = "inputs int, outputs int, first double, last double, error string, code int"


def read_load_test(spark: SparkSession, path: str) -> DataFrame:
    """Rows of load-test files; a line that doesn't fit is an error."""
    return spark.read.schema(LOAD_TEST).option("mode", "FAILFAST").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV files with a header, one folder a report."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def load_test(rows: DataFrame, users: int) -> DataFrame:
    """Means and p90 of a load test's rows (inputs, outputs, first, last) and tokens a second."""
    each = rows.withColumn("next", F.when(F.col("outputs") > 0, (F.col("last") - F.col("first")) / F.col("outputs")))
    names = ["inputs", "outputs", "first", "last", "next"]
    means = each.agg(*[F.avg(c).alias(f"{c}_mean") for c in names], (F.lit(users) / F.avg("next")).alias("tokens_per_second"))
    tall = each.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names])))
    exact = quantiles.percentiles(tall, ["measure"], "value", {"p90": 0.9})
    wide = exact.groupBy().pivot("measure", names).agg(F.first("p90")).select(*[F.col(c).alias(f"{c}_p90") for c in names])
    columns = [x for c in names for x in (f"{c}_mean", f"{c}_p90")]
    return means.join(wide).select(*columns, "tokens_per_second")  # a row on either side


def ingestion_report(rows: DataFrame, steps: list[str]) -> DataFrame:
    """Rows of files with their step times in ms, and a row TOTAL of sums."""
    total = rows.agg(*[F.sum(c).alias(c) for c in ("file_size", "total_chunks", *steps)]).withColumn("file_name", F.lit("TOTAL"))
    names = ["file_name", "file_size", "total_chunks", *steps]
    sums = [sum((F.coalesce(F.col(s), F.lit(0)) for s in steps[1:]), F.coalesce(F.col(steps[0]), F.lit(0))).alias("total")]
    return rows.select(*names, *sums).unionByName(total.select(*names, *sums))
